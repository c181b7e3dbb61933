"""Fixed sentences of position features.

They are shown to readers and feed training text, so they are format values: stated in full here and
nowhere else. Keys are the feature names used by operators.features.
"""

# name, tag, sentence, plan; {o} owner, {x} opponent, {s}/{t} squares
STRUCTURES = {
    "iqp": (
        "IQP ({o} d-pawn on {s})",
        "iqp",
        "{o} has an isolated queen's pawn",
        "{o}: keep pieces, attack the king, use e5/c5 outposts, prepare the d-pawn break. "
        "{x}: blockade the square in front, trade minor pieces, aim for an endgame.",
    ),
    "hanging": (
        "Hanging pawns ({o} c+d)",
        "hanging-pawns",
        "{o} has hanging pawns on {s}/{t}",
        "{o}: keep them side by side, use half-open b/e files, push one when it gains tempo. "
        "{x}: pressure them with pieces and ...b/e-pawn levers to force one to advance or fall.",
    ),
    "carlsbad": (
        "Carlsbad",
        "carlsbad",
        "QGD Exchange pawn structure",
        "White: minority attack b4-b5 to create a weak c-pawn, or central f3+e4. "
        "Black: kingside piece play, knight to e4, ...f5 setups; avoid passivity.",
    ),
    "carlsbad_reversed": (
        "Reversed Carlsbad",
        "carlsbad",
        "Black can play the minority attack ...b5-b4",
        "Black: ...b5-b4 minority attack. White: kingside play, Ne5, f4-f5.",
    ),
    "hedgehog": (
        "Hedgehog",
        "hedgehog",
        "Black pawns a6/b6/d6/e6 behind White's c4+e4",
        "White: restrain ...b5 and ...d5, gain space, avoid overextending. "
        "Black: wait compactly, then strike with ...b5 or ...d5 when prepared.",
    ),
    "maroczy": (
        "Maroczy bind",
        "maroczy",
        "White pawns c4+e4 clamp d5",
        "White: keep the bind, control d5, play on the queenside (c5 break, Rc1). "
        "Black: trade pieces (especially dark-squared bishops), aim for ...b5 or ...f5 breaks.",
    ),
    "scheveningen": (
        "Scheveningen small centre",
        "sicilian",
        "Black d6+e6 vs White e4",
        "White: kingside pawn storm (g4-g5, f4-f5) or e4-e5 break. "
        "Black: ...d5 or ...b5-b4 counterplay, half-open c-file.",
    ),
    "najdorf": (
        "Najdorf/Boleslavsky structure",
        "sicilian",
        "Black d6+e5, hole on d5",
        "White: occupy/control d5 (Nd5, Bxf6), play on the queenside or f4. "
        "Black: challenge d5 with ...d5 break, use the c-file, ...b5.",
    ),
    "french": (
        "French advance chain",
        "french-chain",
        "White d4-e5 vs Black d5-e6",
        "White: space on the kingside, f4-f5 attack, maintain d4. "
        "Black: attack the chain base with ...c5 and ...f6, pressure d4.",
    ),
    "kings_indian": (
        "King's Indian locked centre",
        "kid-locked",
        "White d5+e4 vs Black d6+e5",
        "White: queenside expansion c4-c5, b4, attack d6/c7. "
        "Black: kingside pawn storm ...f5-f4, ...g5-g4 against White's king.",
    ),
    "benoni": (
        "Benoni structure",
        "benoni",
        "White d5 vs Black c5+d6, Black queenside majority",
        "White: e4-e5 break, blockade/pressure d6, restrain ...b5. "
        "Black: ...b5 queenside expansion, use e-file and long diagonal, ...f5 break.",
    ),
    "stonewall": (
        "Stonewall ({o})",
        "stonewall",
        "{o} pawns {s}, hole on {t}",
        "{o}: occupy the outpost with a knight, kingside attack (g-/h-pawn, rook lift). "
        "Opponent: exploit the {t} hole and the bad bishop, trade good minors.",
    ),
}

CENTRE_PLANS = {
    "open": "Open centre: piece play dominates — bishops and rooks gain value, development "
    "and king safety are critical, open files/diagonals toward the king decide.",
    "closed": "Closed (locked) centre: play happens on the wings via pawn breaks; attack on "
    "the side your pawn chain points to; knights often beat bishops; slow "
    "manoeuvring is fine because the centre cannot suddenly open.",
    "dynamic": "Dynamic centre (pawn tension): whoever resolves the tension changes the "
    "character — calculate the exchanges; keep the tension if releasing it "
    "frees the opponent's pieces.",
    "mobile": "Mobile pawn centre: the side with the centre wants to advance it to cramp "
    "and open lines; the other side must blockade or hit it with pawn levers "
    "and pieces before it rolls.",
    "semi-open": "Semi-open centre: one side has a central pawn majority/space; use the "
    "half-open files and pressure the remaining central pawns.",
}

ENDGAME_GUIDE = {
    "pawn": "Pawn ending: every tempo counts — activate the king first, count moves to "
    "promotion for both sides, use the opposition, create an outside passed pawn "
    "to deflect the enemy king.",
    "rook": "Rook ending: activity beats material — rooks belong BEHIND passed pawns (own "
    "and enemy); cut the enemy king off; know Lucena (build a bridge) and Philidor "
    "(rook on the 3rd rank, then check from behind).",
    "opposite-bishops": "Opposite-coloured bishops: very drawish — the defender blockades on "
    "his bishop's colour; the attacker needs two passers far apart.",
    "same-bishops": "Same-coloured bishops: put your pawns on the opposite colour to your "
    "bishop; attack pawns fixed on your bishop's colour.",
    "bishop-knight": "Bishop vs knight: the bishop wants pawns on both wings and an open "
    "board; the knight wants a closed, one-wing position and outposts.",
    "knight": "Knight ending: like a pawn ending — king activity and outside passed pawns "
    "decide; knights struggle against rook pawns.",
    "queen": "Queen ending: king safety and perpetual check dominate — shelter your king, "
    "centralise the queen, a far-advanced passer is worth a lot.",
    "mixed": "Mixed ending: the side ahead in material should trade PIECES not pawns; the "
    "defender trades pawns and seeks a fortress.",
}
