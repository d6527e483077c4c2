"""Brute-force versions that the operators are held against."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, n=5):
    w = words(lower(t))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, percent=80):
    s = {d: shingles(t) for d, t in rows}
    root = {d: d for d in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    post = defaultdict(list)
    for d in sorted(s):
        shared = defaultdict(int)
        for g in s[d]:
            for e in post[g]:
                shared[e] += 1
            post[g].append(d)
        for e, o in shared.items():
            if 100 * o >= percent * (len(s[d]) + len(s[e]) - o):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(s[d]), find(d)) for d in s}


def kept_words(rows, width=13):
    w = {d: words(t) for d, t in rows}
    least = {}
    for d in sorted(w):
        for i in range(len(w[d]) - width + 1):
            least.setdefault(tuple(w[d][i : i + width]), d)
    out = {}
    for d, ws in w.items():
        gone = [False] * len(ws)
        for i in range(len(ws) - width + 1):
            if least[tuple(ws[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out[d] = [x for x, g in zip(ws, gone, strict=True) if not g]
    return out


def contained(rows, items, percent=80):
    out = {}
    for d, t in rows:
        ws, s = words(lower(t)), None
        for i, x in items:
            g = shingles(x)
            if not g:
                continue
            n = min(5, len(words(x)))
            s = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}
            if 100 * len(g & s) >= percent * len(g):
                out[d, i] = (len(g), len(g & s))
    return out


#: Texts that every operator has to take: empty, blank, null, short, other scripts, repeats, special strings, very long,
#: and two words over which polynomial hashes modulo a power of two agree.
_THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
_OTHER = _THUE.translate(str.maketrans("ab", "ba"))
EDGES = [_THUE, _OTHER, f"{_THUE} " + " ".join(f"k{i}" for i in range(20)), f"{_OTHER} " + " ".join(f"k{i}" for i in range(20)), "", None, " ", " \t\n\x0b\f\r ", "one", "a b c d", "a b c d", "A B c D", "日本語 テスト", "é ́x y\u0085z", "<|endoftext|> <s> </s>", "x" * 5000, "again " * 3000, "\x00 \x1c", "a▁ ▁b"]


def mutate(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"m{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(rng, n=60, size=120):
    """Random texts, a large group of near copies, exact copies, a chain, and a passage that many share."""
    vocab = [f"v{i}" for i in range(3000)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    rows = [text(rng.randrange(1, size)) for _ in range(n)]
    base = text(200)
    rows += [mutate(base, rng, rng.randrange(0, 5)) for _ in range(70)]
    rows += [rows[3]] * 40
    chain = text(150)
    for _ in range(12):
        chain = mutate(chain, rng, 2)
        rows.append(chain)
    passage = text(60)
    rows += [f"{text(rng.randrange(0, 90))} {passage} {text(rng.randrange(0, 90))}" for _ in range(60)]
    rng.shuffle(rows)
    return [(7 * i + 3, t) for i, t in enumerate(rows)]
