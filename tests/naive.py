"""A slow move generator on a list of 64 letters, which shares nothing with the package."""

STEPS = {"n": [(1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2)], "b": [(1, 1), (1, -1), (-1, 1), (-1, -1)], "r": [(1, 0), (-1, 0), (0, 1), (0, -1)]}
STEPS["q"] = STEPS["k"] = STEPS["b"] + STEPS["r"]


def start(fen):
    cells, turn, rights, ep = fen.split()[:4]
    board = []
    for row in reversed(cells.split("/")):
        for c in row:
            board += ["."] * int(c) if c.isdigit() else [c]
    return board, turn == "w", rights, -1 if ep == "-" else "abcdefgh".index(ep[0]) + 8 * (int(ep[1]) - 1)


def attacked(board, s, white):
    """Whether White, or else Black, attacks the square."""
    x, y = s % 8, s // 8
    own = str.upper if white else str.lower
    at = lambda a, b: board[a + 8 * b] if 0 <= a < 8 and 0 <= b < 8 else ""
    if any(at(x + d, y - (1 if white else -1)) == own("p") for d in (-1, 1)):
        return True
    for man, steps in STEPS.items():
        for dx, dy in steps:
            a, b = x + dx, y + dy
            while man in "brq" and at(a, b) == ".":
                a, b = a + dx, b + dy
            if at(a, b) == own(man):
                return True
    return False


def play(state, f, t, promotion=""):
    """The move as bytes have it: castling takes the own rook."""
    board, white, rights, ep = state
    board = list(board)
    man, target = board[f], board[t]
    gone = {4: "KQ", 60: "kq", 0: "Q", 7: "K", 56: "q", 63: "k"}
    rights = "".join(r for r in rights if r not in gone.get(f, "") + gone.get(t, "")) or "-"
    board[f] = "."
    if man in "Kk" and target == ("R" if man == "K" else "r"):
        home = f - f % 8
        board[t] = "."
        board[home + (6 if t > f else 2)], board[home + (5 if t > f else 3)] = man, target
        return board, not white, rights, -1
    if man in "Pp" and t == ep and target == ".":
        board[f - f % 8 + t % 8] = "."
    board[t] = (promotion.upper() if white else promotion) or man
    return board, not white, rights, (f + t) // 2 if man in "Pp" and abs(f - t) == 16 else -1


def check(state):
    board, white = state[:2]
    return attacked(board, board.index("K" if white else "k"), not white)


def moves(state):
    board, white, rights, ep = state
    mine = lambda c: c != "." and c.isupper() == white
    out = []
    for f, man in enumerate(board):
        if not mine(man):
            continue
        x, y = f % 8, f // 8
        if man in "Pp":
            up = 1 if white else -1
            to = []
            if board[f + 8 * up] == ".":
                to.append(f + 8 * up)
                if y == (1 if white else 6) and board[f + 16 * up] == ".":
                    to.append(f + 16 * up)
            for d in (-1, 1):
                if 0 <= x + d < 8:
                    t = f + 8 * up + d
                    if (board[t] != "." and not mine(board[t])) or (t == ep and board[t] == "."):
                        to.append(t)
            out += [(f, t, p) for t in to for p in ("qrbn" if t // 8 in (0, 7) else [""])]
            continue
        for dx, dy in STEPS[man.lower()]:
            a, b = x + dx, y + dy
            while 0 <= a < 8 and 0 <= b < 8 and not mine(board[a + 8 * b]):
                out.append((f, a + 8 * b, ""))
                if board[a + 8 * b] != "." or man.lower() in "nk":
                    break
                a, b = a + dx, b + dy
        if man in "Kk":
            for r, rook, free, passed in (("K", 7, (5, 6), (4, 5, 6)), ("Q", 0, (1, 2, 3), (4, 3, 2))):
                base = 0 if white else 56
                if (r if white else r.lower()) in rights and all(board[base + s] == "." for s in free) and not any(attacked(board, base + s, not white) for s in passed):
                    out.append((f, base + rook, ""))
    legal = []
    for m in out:
        after = play(state, *m)
        king = after[0].index("K" if white else "k")
        if not attacked(after[0], king, not white):
            legal.append(m)
    return legal


def replay(fen, hex_):
    """For each move of the bytes whether it is legal, then: check, and the number of replies."""
    state, out = start(fen), []
    raw = bytes.fromhex(hex_)
    for a, b in zip(raw[::2], raw[1::2]):
        m = (a & 63, b & 63, "qrbn"[b >> 6] if a & 64 else "")
        legal = m in moves(state)
        state = play(state, *m)
        out.append((legal, check(state), len(moves(state))))
    return out
