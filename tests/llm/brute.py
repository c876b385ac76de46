"""Plain Python versions of what the operators compute, straight from their contracts."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def targets(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2.0) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in held]
        if not free:
            return held
        level = (total - sum(held.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] >= cap * sizes[s]]
        if not over:
            return held | {s: level * w[s] for s in free}
        held |= {s: cap * sizes[s] for s in over}


def text_rules(text):
    text = text or ""
    own = words(text)
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    n = Counter(windows)
    repeated = {j for i, x in enumerate(windows) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(own), "word_chars": sum(map(len, own)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated)}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def line_dedup(docs: list[tuple]) -> list[tuple]:
    key = lambda x: x.strip(BLANK).translate(ASCII)
    holders = defaultdict(set)
    for i, text in docs:
        for x in (text or "").split("\n"):
            if i is not None and len(key(x)) >= 20:
                holders[key(x)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def fingerprint(text):
    own = words((text or "").translate(ASCII))
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or [" ".join(own)]
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum((2 * n > len(shingles)) << b for b, n in enumerate(bits))


def simhash_components(docs: list[tuple], bits=2) -> dict:
    prints = sorted({fingerprint(t) for _, t in docs})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= bits:
                root[find(p)] = find(q)
    least = {}
    for i, t in docs:
        if i is not None:
            r = find(fingerprint(t))
            least[r] = min(i, least.get(r, i))
    return {p: least.get(find(p)) for p in prints}


def unigram(docs: list[tuple], trains) -> tuple[Counter, int]:
    n = Counter()
    for i, t in docs:
        if trains(i):
            n.update([*words((t or "").translate(ASCII)), None])
    return n, sum(n.values())


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
