"""Sets of squares as 64-bit integers: bit s is square s, a1 = 0 … h8 = 63.

Everything here is integer arithmetic on columns, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = "abcdefgh"
SQUARES = [f"{f}{r}" for r in range(1, 9) for f in FILES]
FULL = (1 << 64) - 1
FILE_A = 0x0101010101010101
RANK_1 = 0xFF


def signed(value: int) -> int:
    value &= FULL
    return value - (1 << 64) if value >> 63 else value


def const(value: int) -> Column:
    return F.lit(signed(value)).cast("bigint")


def file_mask(*files: int) -> int:
    return sum(FILE_A << f for f in files)


def rank_mask(*ranks: int) -> int:
    """Ranks counted from 0."""
    return sum(RANK_1 << (8 * r) for r in ranks)


def sq(name: str) -> int:
    return SQUARES.index(name)


def both(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def either(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def inv(a: Column) -> Column:
    return F.bitwise_not(a)


def minus(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def within(a: Column, mask: int) -> Column:
    return a.bitwiseAND(const(mask))


def left(a: Column, n: int) -> Column:
    return F.shiftleft(a, n)


def right(a: Column, n: int) -> Column:
    return F.shiftrightunsigned(a, n)


def count(a: Column) -> Column:
    return F.bit_count(a)


def bit(square: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), square.cast("int"))


def has(a: Column, square: Column) -> Column:
    return a.bitwiseAND(bit(square)) != 0


def at(a: Column, name: str) -> Column:
    return within(a, 1 << sq(name)) != 0


def east(a: Column) -> Column:
    return left(within(a, FULL ^ file_mask(7)), 1)


def west(a: Column) -> Column:
    return right(within(a, FULL ^ file_mask(0)), 1)


def beside(a: Column) -> Column:
    return either(east(a), west(a))


def north_fill(a: Column) -> Column:
    a = either(a, left(a, 8))
    a = either(a, left(a, 16))
    return either(a, left(a, 32))


def south_fill(a: Column) -> Column:
    a = either(a, right(a, 8))
    a = either(a, right(a, 16))
    return either(a, right(a, 32))


def ahead(a: Column, white: bool, steps: int = 1) -> Column:
    return left(a, 8 * steps) if white else right(a, 8 * steps)


def ahead_fill(a: Column, white: bool) -> Column:
    return north_fill(a) if white else south_fill(a)


def pawn_attacks(pawns: Column, white: bool) -> Column:
    return ahead(beside(pawns), white)


def files8(a: Column) -> Column:
    """Files that hold a member, as bits 0–7."""
    return within(south_fill(a), RANK_1)


def of_files(files: Column) -> Column:
    """All squares of a set of files."""
    return north_fill(files)


def beside8(files: Column) -> Column:
    return within(either(left(files, 1), right(files, 1)), RANK_1)


def knight_attacks(a: Column) -> Column:
    one, two = beside(a), either(east(east(a)), west(west(a)))
    return either(left(one, 16), right(one, 16), left(two, 8), right(two, 8))


def king_attacks(a: Column) -> Column:
    row = either(a, beside(a))
    return minus(either(row, left(row, 8), right(row, 8)), a)


_NAMES = "".join(SQUARES)


def let(value: Column, fn) -> Column:
    """fn(value) with the value computed once, however often fn uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), lambda v: fn(v)), 1)


def squares(a: Column) -> Column:
    """Members in ascending order: one fold step per member, bit 63 (the sign) last."""
    nothing = F.array().cast("array<int>")

    def pop(state, _):
        rest = state["rest"]
        return F.struct(
            rest.bitwiseAND(rest - 1).alias("rest"),
            F.array_append(state["out"], count(minus(rest - 1, rest)).cast("int")).alias("out"),
        )

    def members(m):
        low = m.bitwiseAND(F.lit((1 << 63) - 1))
        start = F.struct(low.alias("rest"), nothing.alias("out"))
        steps = F.sequence(F.lit(1), count(low).cast("int"))
        found = F.when(low == 0, nothing).otherwise(F.aggregate(steps, start, pop, lambda s: s["out"]))
        return F.when(m < 0, F.concat(found, F.array(F.lit(63)))).otherwise(found)

    return F.when(a == 0, nothing).otherwise(let(a, members))


def names(a: Column) -> Column:
    return F.transform(squares(a), lambda i: name_of(i))


def name_of(square: Column) -> Column:
    """Two letters out of one literal, which is far smaller in a plan than a 64-entry array."""
    return F.substr(F.lit(_NAMES), square * 2 + 1, F.lit(2))


def joined(a: Column, text, sep: str = ", ") -> Column:
    """`text(square number)` of the members, ascending: branches rank by rank, compiled as lambdas aren't."""
    row = lambda r: F.concat_ws(
        sep, *[F.when(within(a, 1 << s) != 0, text(s)) for s in range(8 * r, 8 * r + 8)]
    )
    rows = [F.when(within(a, rank_mask(r)) != 0, row(r)) for r in range(8)]
    return F.when(a.isNotNull(), F.concat_ws(sep, *rows))


def names_text(a: Column, sep: str = ", ") -> Column:
    return joined(a, lambda s: F.lit(SQUARES[s]), sep)


def file_letters(files: Column, sep: str = ", ") -> Column:
    """Letters of a set of files, NULL-free and codegen-friendly."""
    return F.concat_ws(sep, *[F.when(within(files, 1 << f) != 0, F.lit(FILES[f])) for f in range(8)])


def highest(a: Column) -> Column:
    """Highest member, NULL when empty."""
    for n in (1, 2, 4, 8, 16, 32):
        a = either(a, right(a, n))
    return F.when(a != 0, (count(a) - 1).cast("int"))
