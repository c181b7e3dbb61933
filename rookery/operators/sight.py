"""What pieces see, for batches of boards: numpy on square sets, a position in its row.

Boards are 64 characters as in `boards`; other characters and missing squares are empty. A batch is worked
in blocks, so that memory is bounded by the block and not by the edges between pieces.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rookery.functions.bits import SQUARES

_PIECES = "PNBRQKpnbrqk"
_BLOCK = 1024
_ORTH, _DIAG = [(1, 0), (0, 1), (-1, 0), (0, -1)], [(1, 1), (-1, 1), (-1, -1), (1, -1)]
_KNIGHT = [(1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2)]
_LEAPS = {"N": _KNIGHT, "K": _ORTH + _DIAG, "P": [(-1, 1), (1, 1)], "p": [(-1, -1), (1, -1)]}
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _next(s: int, step: tuple[int, int]) -> int | None:
    f, r = s % 8 + step[0], s // 8 + step[1]
    return r * 8 + f if 0 <= f < 8 and 0 <= r < 8 else None


def _leap_table() -> np.ndarray:
    """Squares a pawn, knight or king sees, by piece code (0 empty) and square."""
    table = np.zeros((len(_PIECES) + 1, 64), np.uint64)
    for code, piece in enumerate(_PIECES, 1):
        for step in _LEAPS.get(piece, _LEAPS.get(piece.upper(), []) if piece != "p" else []):
            for s in range(64):
                if (to := _next(s, step)) is not None:
                    table[code, s] |= _BIT[to]
    return table


_LEAP = _leap_table()
_CODE = np.zeros(256, np.uint8)
for _i, _p in enumerate(_PIECES, 1):
    _CODE[ord(_p)] = _i


def codes(boards: list) -> np.ndarray:
    """Piece codes, a row per square and a column per board."""
    text = np.array([(b or "").encode("ascii", "replace") for b in boards], "S64")
    return np.ascontiguousarray(_CODE[text.view(np.uint8).reshape(len(boards), 64)].T)


def _kind(code: np.ndarray, letters: str) -> np.ndarray:
    return np.array([x in letters for x in f".{_PIECES}"])[code]


def seen(code: np.ndarray) -> np.ndarray:
    """The set that each square's piece attacks or defends, a row per square."""
    out = _LEAP[code, np.arange(64)[:, None]]
    free = code == 0
    for steps, letters in ((_ORTH, "RQrq"), (_DIAG, "BQbq")):
        slider = _kind(code, letters)
        for step in steps:
            line = np.zeros(code.shape, np.uint64)
            for s in range(63, -1, -1) if step[0] + 8 * step[1] > 0 else range(64):
                if (to := _next(s, step)) is not None:
                    line[s] = _BIT[to] | np.where(free[to], line[to], np.uint64(0))
            out |= np.where(slider, line, np.uint64(0))
    return out


def _union(sets: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduce(sets, axis=0)


def _members(chosen: np.ndarray) -> np.ndarray:
    return _union(np.where(chosen, _BIT[:, None], np.uint64(0)))


def _touched(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(attackers, defenders) of every square's piece: the first one along each line, if it slides there, and leapers."""
    free, white = code == 0, (code > 0) & (code <= 6)
    by = np.zeros(code.shape, np.uint64)
    for steps, letters in ((_ORTH, "RQrq"), (_DIAG, "BQbq")):
        sliders = _members(_kind(code, letters))
        for step in steps:
            first = np.zeros(code.shape, np.uint64)
            for s in range(63, -1, -1) if step[0] + 8 * step[1] > 0 else range(64):
                if (to := _next(s, step)) is not None:
                    first[s] = np.where(free[to], first[to], _BIT[to])
            by |= first & sliders
    for letters, back in (("Nn", "N"), ("Kk", "K"), ("P", "p"), ("p", "P")):
        by |= _LEAP[_PIECES.index(back) + 1][:, None] & _members(_kind(code, letters))
    by[free] = 0
    mates = np.where(white, _members(white), _members(code > 6))
    return by & ~mates, by & mates


_LETTERS = pa.array(["", *_PIECES])
_CONTACT = pa.struct([("sq", pa.int32()), ("piece", pa.string()), ("attackers", pa.int64()), ("defenders", pa.int64())])


def _merged(own, sq, piece, att, dfn) -> tuple[np.ndarray, ...]:
    """Contacts with equal pieces of an owner as one, in order."""
    key, at = np.unique((own * 64 + sq) * 16 + piece, return_inverse=True)
    both = np.zeros((2, len(key)), np.uint64)
    np.bitwise_or.at(both[0], at, att)
    np.bitwise_or.at(both[1], at, dfn)
    return key // 1024, key // 16 % 64, key % 16, *both


def _contacts(owner: np.ndarray, boards: list) -> tuple[np.ndarray, ...]:
    """(owner, sq, piece code, attackers, defenders) of pieces but kings that another one sees, in this order.

    Equal pieces of an owner's boards are one. `owner` ascends.
    """
    parts = [[np.empty(0, x) for x in (np.int64, np.int64, np.uint8, np.uint64, np.uint64)]]
    several = owner[1:] == owner[:-1]
    for i in range(0, len(boards), _BLOCK):
        code = codes(boards[i : i + _BLOCK])
        att, dfn = _touched(code)
        b, sq = np.nonzero((((att | dfn) != 0) & (code > 0) & ~_kind(code, "Kk")).T)
        part = owner[i + b], sq, code[sq, b], att[sq, b], dfn[sq, b]
        parts.append(_merged(*part) if several[i : i + _BLOCK].any() else part)
    men = tuple(np.concatenate(x) for x in zip(*parts))
    return _merged(*men) if several.any() else men


def _contact_lists(boards: pa.Array) -> pa.Array:
    """Pieces but kings that another one sees, of lists of boards; equal pieces of a list's boards are one."""
    lists = boards.to_pylist()
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    own, sq, piece, att, dfn = _contacts(owner, [b for x in lists for b in x])
    rows = pa.StructArray.from_arrays(
        [pa.array(sq.astype(np.int32)), _LETTERS.take(pa.array(piece.astype(np.int32))),
         pa.array(att.astype(np.int64)), pa.array(dfn.astype(np.int64))], fields=list(_CONTACT))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(lists) + 1)).astype(np.int32)), rows)


def contact_lists(df: DataFrame, key: list[str], board: str = "board") -> DataFrame:
    """key, contacts: one row per key, its touched pieces in one array.

    A position is a narrow row when it is hashed by its key, and stays in its task afterwards.
    """
    lists = F.arrow_udf(_contact_lists, "array<struct<sq:int,piece:string,attackers:bigint,defenders:bigint>>")
    one = df.select(*key, F.col(board).alias("_board")).repartition(*key).groupBy(*key)
    return one.agg(F.collect_set("_board").alias("_boards")).select(*key, lists("_boards").alias("contacts"))


def _move_sets(before: pa.Array, after: pa.Array, frm: pa.Array, to: pa.Array, mover: pa.Array) -> pa.Array:
    names = ("any", "mover_now", "mover_then", "theirs", "ours", "opened")
    cols = {n: [] for n in names}
    texts, later = before.to_pylist(), after.to_pylist()
    source, goal = (x.fill_null(64).to_numpy(zero_copy_only=False) for x in (frm, to))
    white_moves = np.array([m == "white" for m in mover.to_pylist()], bool)
    black_moves = np.array([m == "black" for m in mover.to_pylist()], bool)
    at, none = np.arange(64)[:, None], np.uint64(0)
    for i in range(0, len(texts), _BLOCK):
        own = slice(i, i + _BLOCK)
        then, now = codes(texts[own]), codes(later[own])
        was, sees = seen(then), seen(now)
        light, dark = white_moves[own], black_moves[own]
        side = lambda code: np.where((code > 0) & (code <= 6), light, (code > 6) & dark)
        # whose pieces may be hit: the side against the mover, without its king
        us = lambda code: _members(np.where(light, (code > 6) & (code < 12), (code > 0) & (code < 6)))
        slides = lambda code: _kind(code, "BRQbrq") & side(code)
        before_line = np.where(slides(then), was, none) & us(then)
        line = np.where(slides(now) & (at != goal[own]), sees, none) & us(now)
        cols["any"].append((_union(was) | _union(sees)) != 0)
        cols["mover_now"].append(_union(np.where(at == goal[own], sees, none)))
        cols["mover_then"].append(_union(np.where(at == source[own], was, none)))
        cols["theirs"].append(_union(np.where(side(now), sees, none)))
        cols["ours"].append(_union(np.where(~side(now) & (now > 0), sees, none)))
        cols["opened"].append((line & ~before_line).T)
    if not texts:
        return pa.array([], _MOVE)
    flat = {n: np.concatenate(v) for n, v in cols.items()}
    arrays = [pa.array(flat["any"]), *[pa.array(flat[n].astype(np.int64)) for n in names[1:5]]]
    opened = pa.array(np.ascontiguousarray(flat["opened"]).reshape(-1).astype(np.int64))
    ends = pa.array(np.arange(0, len(opened) + 1, 64, dtype=np.int32))
    return pa.StructArray.from_arrays([*arrays, pa.ListArray.from_arrays(ends, opened)], fields=list(_MOVE))


_MOVE = pa.struct([("any", pa.bool_()), *[(n, pa.int64()) for n in ("mover_now", "mover_then", "theirs", "ours")],
                   ("opened", pa.list_(pa.int64()))])


def move_sets(before: Column, after: Column, frm: Column, to: Column, mover: Column) -> Column:
    """Sets of a move: what the mover saw and sees, the mover's side and the other; `opened` by slider square."""
    made = F.arrow_udf(
        _move_sets, "struct<any:boolean,mover_now:bigint,mover_then:bigint,theirs:bigint,ours:bigint,opened:array<bigint>>")
    return made(before, after, frm.cast("int"), to.cast("int"), mover)


# --- relations ----------------------------------------------------------------------------------
_VALUES = {"P": 1, "N": 3, "B": 3, "R": 5, "Q": 9, "K": 0}
_WORTH = np.array([0, *[_VALUES[x.upper()] for x in _PIECES]])
_RANK = np.array([5, 4, 0, 3, 0, 2, 0, 0, 0, 1, 0])  # most valuable first, before them what has no value (-1)
_ASCII = np.frombuffer(b"." + _PIECES.encode(), np.uint8)
_NEXT, _HIT, _LOOSE, _SOLE = 1, 2, 4, 5  # blocks of `_words`; a black piece's hit is one further


@lru_cache(4)
def _words(marks: tuple[int, ...]) -> pa.Array:
    """What sentences are made of: blocks of names of (letter, square), then the two words on guards."""
    names = [((chr(x).upper() if x else "") + s, "White" if 65 <= x <= 90 else "Black") for x in marks for s in SQUARES]
    blocks = [
        [n for n, _ in names], [f", {n}" for n, _ in names],
        *[[f"{side} {n}: attacked by " for n, _ in names] for side in ("White", "Black")],
        [f"{side} {n}: loose (undefended, not attacked yet)" for n, side in names],
        [f"OVERLOADED: {side} {n} is the only defender of " for n, side in names],
    ]
    return pa.array([*[x for block in blocks for x in block], "; UNDEFENDED", "; defended by "], pa.string())


def _squares_of(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, square) of the members of sets, ascending."""
    flat = np.flatnonzero(np.unpackbits(sets.astype("<u8").view(np.uint8), bitorder="little").view(bool))
    return flat >> 6, flat & 63


def _overloaded(row, sq, piece, guard) -> tuple[np.ndarray, ...]:
    """Guards that alone defend two pieces or more: (row, place in the row, square), then (guard, piece) by index."""
    order = np.lexsort((_ASCII[piece], -sq, row))
    key, first, index, n = np.unique((row * 64 + guard)[order], return_index=True, return_inverse=True, return_counts=True)
    some = np.flatnonzero(n >= 2)
    some = some[np.argsort(first[some])]
    rows, place = key[some] // 64, np.full(len(key), -1)
    place[some] = np.arange(len(some))
    held = place[index] >= 0
    return rows, np.arange(len(some)) - np.searchsorted(rows, rows), key[some] % 64, place[index][held], order[held]


def _sentences(boards: list, men: tuple[np.ndarray, ...], free: np.ndarray, top: int) -> tuple[np.ndarray, pa.Array]:
    """(row, text): the `top` best sentences of every board, best first.

    `men` are contacts with the board's row as owner, `free` the squares of pieces that may be loose. Items are
    ranked as numbers, and only the ones told are put into words: tokens of a fixed list, which lie behind each
    other in one buffer, so that a sentence is a range of it.
    """
    text = np.array([b or "" for b in boards], "U64").view(np.uint32).reshape(len(boards), 64)
    present = np.zeros(int(text.max(initial=0)) + 1, bool)
    present[text] = True
    marks = tuple(np.flatnonzero(present).tolist())
    letter = (np.cumsum(present) - 1)[text]
    worth = np.array([_VALUES.get(chr(x).upper(), -1) for x in marks], np.int64)
    words, width = _words(marks), 64 * len(marks)
    name = lambda r, s: letter[r, s] * 64 + s

    row, sq, piece, att, dfn = (x[men[3] != 0] for x in men)
    bare, at = dfn == 0, np.flatnonzero(np.bitwise_count(dfn) == 1)
    guard_row, place, guard, held_by, held = _overloaded(row[at], sq[at], piece[at], np.bitwise_count(dfn[at] - np.uint64(1)).astype(np.int64))
    held = at[held]
    loose_row, loose = _squares_of(free)
    value = worth[letter[loose_row, loose]]

    # row, score from the best, place: pieces from h8 on, guards after them; a letter without a value goes first
    rows = np.concatenate([row, loose_row, guard_row])
    score = np.concatenate([_WORTH[piece] * 10 + 5 * bare, np.where(value < 0, 127, value), np.full(len(guard), 50)])
    order = np.concatenate([64 - sq, 64 - loose, 128 + place])
    packed = np.sort((((rows << 8) + 127 - score << 8) + order << 24) + np.arange(len(rows)))
    rank, item = packed >> 24, packed & (1 << 24) - 1
    first = np.flatnonzero(np.diff(rank, prepend=-1))  # of equal ranks; they are told apart by their texts only
    start = np.repeat(first, np.diff(first, append=len(rank)))
    told = start - np.searchsorted(rank >> 16, rank >> 16) < top
    rank, item = rank[told], item[told]
    rows = rank >> 16
    if not len(item):
        return rows, pa.array([], pa.string())

    heads = np.concatenate([(_HIT + (piece > 6)) * width + name(row, sq), _LOOSE * width + name(loose_row, loose), _SOLE * width + name(guard_row, guard)])
    hit = np.flatnonzero(item < len(row))
    token = lambda t, part, r, s, v: (((t << 2) + part << 3) + _RANK[v] << 6) + s

    def listed(part: int, sets: np.ndarray) -> np.ndarray:
        i, s = _squares_of(sets[item[hit]])
        return token(hit[i], part, rows[hit[i]], s, worth[letter[rows[hit[i]], s]])

    told_at = np.full(len(heads), -1)
    told_at[item] = np.arange(len(item))
    owner = told_at[len(row) + len(loose) + held_by]
    owned, held = owner[owner >= 0], held[owner >= 0]
    tokens = np.sort(np.concatenate([
        np.arange(len(item)) << 11, listed(1, att), (hit << 11) + (2 << 9), listed(3, dfn),
        token(owned, 1, rows[owned], sq[held], _WORTH[piece[held]]),
    ]))
    of, part, s = tokens >> 11, tokens >> 9 & 3, tokens & 63
    later = np.diff(tokens >> 9, prepend=-1) == 0
    word = np.where(part & 1, (_NEXT * later) * width + name(rows[of], s), heads[item[of]])
    joint = part == 2
    word[joint] = len(words) - np.where(bare[item[of[joint]]], 2, 1)
    said = words.take(pa.array(word))
    ends = np.frombuffer(said.buffers()[1], np.int32, len(said) + 1)[np.append(np.flatnonzero(part == 0), len(said))]
    texts = pa.StringArray.from_buffers(len(item), pa.py_buffer(np.ascontiguousarray(ends)), said.buffers()[2])
    if any(b is None for b in boards):
        texts = pc.if_else(pa.array(np.array([b is None for b in boards])[rows]), pa.scalar(None, pa.string()), texts)
    if (np.diff(rank) == 0).any():
        plain = [(x or "").encode() for x in texts.to_pylist()]
        by_text = sorted(range(len(plain)), key=lambda i: (rank[i], plain[i]))
        by_text = np.array(by_text)[np.arange(len(plain)) - np.searchsorted(rows, rows) < top]
        rows, texts = rows[by_text], texts.take(pa.array(by_text))
    return rows, texts


def relation_lists(df: DataFrame, key: list[str], free: Column, top: int, board: str = "board") -> DataFrame:
    """key, relations: a row per position; pieces of a key's positions are in sight of each other.

    `free` is the set of pieces that may be loose. Rows are hashed by the key once and sorted by it, then worked
    block by block; rows without a key, which touch nothing, are hashed by what they hold.
    """
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in key])
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    rows = df.select(*key, F.col(board).alias("_board"), free.alias("_free"), known.alias("_known"))
    rows = rows.withColumn("_apart", F.when(~F.col("_known"), F.xxhash64("_board", "_free")))
    at = F.row_number().over(Window.partitionBy(*key, "_apart").orderBy("_apart"))
    rows = rows.repartition(n, *key, "_apart").select(*key, "_board", "_free", "_known", (at == 1).alias("_first"))

    def told(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks()
        flag = lambda c: table[c].to_numpy(zero_copy_only=False).astype(bool)
        boards, free, owner = table["_board"].to_pylist(), table["_free"], np.cumsum(flag("_first"))
        sets, known = free.fill_null(0).to_numpy().view(np.uint64), flag("_known")
        men = _contacts(owner[known], [b for b, k in zip(boards, known) if k])
        seen = np.zeros(len(boards) + 1, np.uint64)
        np.bitwise_or.at(seen, men[0], _BIT[men[1]])
        begin, end = np.searchsorted(men[0], owner), np.searchsorted(men[0], owner, "right")
        for i in range(0, len(boards), _BLOCK):
            own = slice(i, i + _BLOCK)
            size = end[own] - begin[own]
            at = np.repeat(end[own] - np.cumsum(size), size) + np.arange(size.sum())
            near = (np.repeat(np.arange(len(size)), size), *(x[at] for x in men[1:]))
            row, texts = _sentences(boards[own], near, sets[own] & ~seen[owner[own]], top)
            ends = pa.array(np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, texts, mask=free[own].is_null().combine_chunks() if free.null_count else None)
            keys = table.select(key).slice(i, _BLOCK).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*keys.columns, lists], names=[*key, "relations"])

    def work(batches):
        held = []  # rows up to the last key, which may go on in the next batch
        for batch in batches:
            starts = np.flatnonzero(batch.column("_first").to_numpy(zero_copy_only=False))
            if len(starts):
                yield from told([*held, batch.slice(0, starts[-1])])
                held, batch = [], batch.slice(starts[-1])
            held.append(batch)
        if held:
            yield from told(held)

    schema = StructType([*df.select(*key).schema.fields, *StructType.fromDDL("relations array<string>").fields])
    return rows.mapInArrow(work, schema)


# --- claims -------------------------------------------------------------------------------------
# a token is a letter and a square; tokens in the order of their texts: letter, file, rank
_TOKENS = pa.array([f"{chr(65 + x)}{'abcdefgh'[f]}{r + 1}" for x in range(26) for f in range(8) for r in range(8)])
_SQUARE_TOKEN = np.array([s % 8 * 8 + s // 8 for s in range(64)])
_CLAIM = r"(?P<piece>[KQRBNPkqrbnp]?)[ \t\n\x0b\f\r]*(?P<square>[a-h][1-8])"


def _pieces(boards: pa.Array, white: bool) -> tuple[np.ndarray, np.ndarray]:
    """(board, token) of one side's letters, board by board and by square."""
    text = np.array([(b or "").encode("ascii", "replace") for b in boards.to_pylist()], "S64")
    letter = text.view(np.uint8).reshape(len(boards), 64).astype(np.int64) - (65 if white else 97)
    row, sq = np.nonzero((letter >= 0) & (letter < 26))
    return row, letter[row, sq] * 64 + _SQUARE_TOKEN[sq]


def _claimed(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(list, token) of every claim that names a square; a bare square is a pawn."""
    items = pc.list_flatten(lists).dictionary_encode()
    found = pc.extract_regex(items.dictionary, _CLAIM)
    piece, square = pc.struct_field(found, 0), pc.struct_field(found, 1)
    piece = pc.if_else(pc.equal(piece, ""), "P", pc.utf8_upper(piece))
    token = pc.index_in(pc.binary_join_element_wise(piece, square, ""), _TOKENS).take(items.indices)
    kept = pc.is_valid(token).to_numpy(zero_copy_only=False)
    return pc.list_parent_indices(lists).to_numpy()[kept], token.drop_null().to_numpy().astype(np.int64)


def _token_lists(row: np.ndarray, token: np.ndarray, rows: int) -> pa.Array:
    ends = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _TOKENS.take(pa.array(token)))


def side_pieces(board: Column, white: bool) -> Column:
    """Letter and square of one side's pieces, by square."""
    def listed(boards: pa.Array) -> pa.Array:
        return _token_lists(*_pieces(boards, white), len(boards))

    return F.arrow_udf(listed, "array<string>")(board)


def compare_claims(df: DataFrame, board: str, white: str, black: str) -> DataFrame:
    """Adds pieces_total, pieces_correct, missing and phantom: claims of either side against its pieces.

    The lists hold tokens of White, then of Black, each sorted and once.
    """
    def work(batches):
        for batch in batches:
            n, width = batch.num_rows, len(_TOKENS)
            key = lambda pair, side: (pair[0] * 2 + side) * width + pair[1]
            true, said = ([], [])
            for side, name in enumerate((white, black)):
                true.append(key(_pieces(batch.column(board), side == 0), side))
                said.append(key(_claimed(batch.column(name)), side))
            true, said = (np.unique(np.concatenate(x)) for x in (true, said))
            missing, phantom = (np.setdiff1d(x, y, assume_unique=True) for x, y in ((true, said), (said, true)))
            count = lambda keys: np.bincount(keys // (2 * width), minlength=n).astype(np.int32)
            lists = [_token_lists(x // (2 * width), x % width, n) for x in (missing, phantom)]
            new = [pa.array(count(true)), pa.array(count(true) - count(missing)), *lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.fieldNames())

    added = StructType.fromDDL("pieces_total int, pieces_correct int, missing array<string>, phantom array<string>")
    schema = StructType([*df.schema.fields, *added.fields])
    return df.mapInArrow(work, schema)
