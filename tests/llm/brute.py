"""Plain row-at-a-time versions of what the operators return, straight from their descriptions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import xxhash


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(n: int, links) -> list[int]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def op1(docs: list[tuple], shingle: int = 4, radius: int = 4) -> dict:
    """(id, text) -> id -> (fingerprint, component)"""
    prints = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        s = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
        prints.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    seen = sorted(set(prints))
    at = {p: i for i, p in enumerate(seen)}
    root = components(len(seen), ((i, j) for i in range(len(seen)) for j in range(i) if (seen[i] ^ seen[j]).bit_count() <= radius))
    least: dict = {}
    for (i, _), p in zip(docs, prints, strict=True):
        r = root[at[p]]
        least[r] = min(least.get(r, i), i)
    return {i: (f"{p:016x}", least[root[at[p]]]) for (i, _), p in zip(docs, prints, strict=True)}


def _digest(spans: list[tuple], kinds: list[str]) -> tuple:
    spans = sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))
    return (*[sum(s[0] == k for s in spans) for k in kinds], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)))


def op5(text: str | None) -> tuple:
    text, spans = text or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        spans += [("assign", *m.span())] * (len(m[2]) >= 6)
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return _digest(spans, ["assign", "access", "hex"])


def entropy(text: str) -> float:
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())


def luhn(text: str) -> bool:
    d = [int(c) for c in text if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def op8(text: str | None) -> tuple:
    text, spans = text or "", []
    digits = lambda t: len(re.findall("[0-9]", t))
    spans += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    spans += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= digits(m[0]) <= 19 and luhn(m[0])]
    spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= digits(m[0]) <= 15]
    return _digest(spans, ["email", "ip", "card", "phone"])


def op9(docs: list[tuple], items: list[tuple], window: int = 10) -> dict:
    """-> id -> (n_words, n_hit, n_items, items_sha256)"""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    known = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1)) if w else ():
            known[tuple(w[s : s + window])].add(str(i))
    sizes, out = {len(k) for k in known}, {}
    for i, t in docs:
        w, hit, got = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if found := known.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    got |= found
        out[i] = (len(w), len(hit), len(got), sha(",".join(sorted(got))))
    return out


def op10(docs: list[tuple], size: int = 400) -> dict:
    """-> id -> (n_bytes, n_removed, n_spans, kept_sha256)"""
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(hash(b[s : s + size]) for _, b in data for s in range(len(b) - size + 1))
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if seen[hash(b[s : s + size])] > 1:
                gone[s : s + size] = b"\1" * size
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def op7(vectors: list[tuple], every: int = 20, k: int = 20) -> set:
    """(id, list) -> {(query, rank, id, score)}"""
    ints = {i: [math.floor(64 * float(x)) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in (i for i in ints if i % every == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best[:k])}
    return out


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def op11(text: str | None) -> tuple:
    text = text or ""
    words, lines, seen = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)], set()
    dup = sum(x in seen or seen.add(x) is not None for x in lines)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeat = len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)})
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, repeat, len(words) < 50 or 100 * repeat > 50 * len(words)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def grouped(counts: dict[str, int], ratio: int = 5) -> set[tuple]:
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, x in near.items():
        best = min(x, key=lambda y: (-counts[y], y), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w: str) -> str:
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), None if form[w] is None else counts[form[w]]) for w, n in counts.items()}


def op12(docs: list[tuple], least: int = 6, count: int = 5, every: int = 199) -> set[tuple]:
    seen: Counter = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return grouped({w: n for w, n in seen.items() if len(w) >= least and n >= count})


def op13(docs: list[tuple], labels: list[tuple]) -> set[tuple]:
    """(id, text, source) and (id, quality, toxic), by going through every order document by document."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    first: dict = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    parts = defaultdict(list)
    for i, text, source in docs:
        t = text or ""
        w = WORDS.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        parts[source or ""].append((i, {f for f, x in fails.items() if x}))
    out, sums = [], Counter()
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                sums[part, f] += len(gone)
                out.append((part, order, k + 1, len(left), len(gone), sum(f in s and bool(s & set(order[:k])) for _, s in rows), sum(s == {f} for _, s in rows), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
    return {(*x, sums[x[0], x[1][x[2] - 1]]) for x in out}
