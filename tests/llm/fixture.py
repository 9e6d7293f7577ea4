"""A small corpus with what goes wrong in large ones, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, doc string, row string"


def corpus(n: int = 60, seed: int = 1) -> list[tuple]:
    """(doc_id, text, lang, source): copies, near copies, shared passages and lines, nulls, blanks, one very long text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    words = lambda k: " ".join(word() for _ in range(k))
    passage, line = words(45), "This Line is repeated in very many documents, É"
    out: list[tuple] = []
    for i in range(n):
        text = words(rng.randint(5, 60))
        if i % 4 == 0:
            text = f"{words(3)} {passage}\n{text}"
        if i % 3 == 0:
            text = f"{text}\n  {line.upper() if i % 6 else line}\t\n{words(4)}"
        if i % 7 == 0 and out:
            text = out[rng.randrange(len(out))][1]
        out.append((i, text, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "cold", None])))
    base = words(200).split()
    for j in range(6):
        copy = list(base)
        copy[rng.randrange(200)] = word()
        out.append((n + j, " ".join(copy), "en", "hot"))
    out += [(900, None, None, None), (901, "", "en", "cold"), (902, " \t\n\r\n ", "en", "cold"), (903, words(9000), "en", "hot"), (904, "x " * 30, "en", "hot"), (905, "x " * 30, "en", "hot"), (None, words(30), "en", "cold")]
    return [r if r[1] is not None else r for r in out]


def frame(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "h", "doc", "row") for r in rows], SCHEMA)


WS = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def key_of(i):
    return -(2**63) if i is None else i


def plain_substrings(rows, size=20):
    seen, out = set(), {}
    for i, text, *_ in sorted(rows, key=lambda r: key_of(r[0])):
        w, hit = split(text), set()
        for k in range(len(w) - size + 1):
            t = tuple(w[k : k + size])
            if t in seen:
                hit.update(range(k, k + size))
            seen.add(t)
        out[i] = (len(w), len(hit), sha(" ".join(x for k, x in enumerate(w) if k not in hit)))
    return out


def plain_lines(rows, chars=40, docs=5):
    key = lambda x: x.strip(WS).translate(LOW)
    held = defaultdict(set)
    for i, text, *_ in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= chars:
                held[key(x)].add(key_of(i))
    last = {k: max(v) for k, v in held.items() if len(v) >= docs}
    out = {}
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if last.get(key(x), key_of(i)) == key_of(i)]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def plain_fingerprint(text, width=3):
    w = split((text or "").translate(LOW))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: dict, radius=2):
    ids = sorted(prints, key=key_of)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if key_of(a) < key_of(b) and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)), key=key_of)
                parent[y] = x
    return {i: find(i) for i in ids}


def plain_hits(rows, items, size=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = defaultdict(set)
    for i, text in items:
        w = find(text)
        for k in range(max(1, len(w) - size + 1) if w and i is not None else 0):
            windows[tuple(w[k : k + size])].add(str(i))
    out = {}
    for i, text, *_ in rows:
        w, hit, names = find(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        out[i] = (len(w), sorted(hit), sorted(names))
    return out


def plain_counts(text):
    w = split(text)
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(five)
    covered = {k for i, f in enumerate(five) if n[f] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if split(x):
            dup += x in seen
            seen.add(x)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered))
