"""Small documents with every odd case, and plain versions of the operators to compare with."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, node string, row string, "
    "gone string, key string, bucket int, doc_key string, label string"
)
WORD = re.compile("[^\x20\x09-\x0D]+")
PLAIN = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    out = []
    for k in range(words):
        out.append(rng.choice("aeioubdfkéü") + str(rng.randrange(vocabulary)) + rng.choice(["", "", "", ".", ","]))
        out.append("\n" if rng.random() < 0.08 else " ")
    return "".join(out).strip()


def odd_rows() -> list[tuple]:
    """Rows (doc_id, text): nulls, empty and long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(11)
    base = [prose(rng, rng.randrange(40, 160)) for _ in range(12)]
    shared = prose(rng, 60)
    long = prose(rng, 9000, 5000)
    words = base[3].split(" ")
    near = [" ".join([*words[:k * 7], "changed", *words[k * 7 + 1:]]) for k in range(1, 4)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0]), (22, f"{base[1]}\n{shared}"), (23, f"{shared}\n{base[2]}")]
    rows += [(30 + k, t) for k, t in enumerate(near)]
    rows += [(40, long), (41, long + " end"), (42, "word " * 3000), (43, "a" * 3000), (44, "one"), (45, "one two"),
             (46, "   \n\t "), (47, ""), (48, None), (None, base[5]), (None, None), (None, shared),
             (50, base[6]), (50, base[6]), (51, base[7]), (51, base[8] + " x"), (52, "line a\nline b\nline c\nline a\nline b\nline c"),
             (53, "line a\n\nline b \n line c\nlast"), (54, "\x0bodd\x0cspace\rhere "), (55, "Z" * 99), (56, "Z" * 100), (57, "Z" * 101)]
    return rows


def frame(spark, rows):
    """The rows with the other columns of documents, and columns whose names the operators use themselves."""
    full = [(i, t, "en", "src0", len(t or ""), "x", "x", "x", "x", "x", 1, "x", "x") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def sha(value: bytes) -> str:
    return hashlib.sha256(value).hexdigest()


def same(got, want) -> None:
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    got, want = order(got), order(want)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b


# ---- plain versions ----


def quality(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    threes = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {t for t in set(threes) if threes.count(t) > 1} if len(set(threes)) < len(threes) else set()
    repeat = {i + k for i, t in enumerate(threes) if t in twice for k in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n, chars, symbols = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)
    dup = len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(repeat) > 50 * n
    letters = sum(any(c.isalpha() for c in w) for w in words)
    cut = sum(bool(re.search("(\\.\\.\\.|…)[ \t-\r]*$", line)) for line in lines)
    kept = not (
        failed or symbols > n or (len(lines) >= 4 and dup * 100 > len(lines) * 60) or chars < 2 * n or chars > 20 * n
        or 100 * letters < 80 * n or (len(lines) >= 4 and cut * 100 > 60 * len(lines))
        or 2 * sum(c in "0123456789" for c in text) > chars)
    return n, chars, symbols, dup, len(repeat), failed, kept


def license_base(text: str | None) -> tuple:
    words = PLAIN.findall((text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def substring(rows: list[tuple], window: int) -> list[tuple]:
    words = [WORD.findall(t or "") for _, t in rows]
    seen: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i:i + window])] = seen.get(tuple(w[i:i + window]), 0) + 1
    out = []
    for (doc, _), w in zip(rows, words):
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for k in range(window)}
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode())))
    return out


def byte_strings(rows: list[tuple], window: int) -> list[tuple]:
    """Rows with the same id and text are one document; a missing id comes first, ties by digest."""
    def order(row):
        doc, raw = row
        return (-(1 << 63) if doc is None else doc, hashlib.md5(raw).digest())

    texts = [(doc, (t or "").encode()) for doc, t in rows]
    seen, result = set(), {}
    for doc, raw in sorted(set(texts), key=order):
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if raw[i:i + window] in seen:
                gone[i:i + window] = b"\1" * window
            else:
                seen.add(raw[i:i + window])
        runs = len([x for x in bytes(gone).split(b"\0") if x])
        result[doc, raw] = (doc, len(raw), sum(gone), runs, sha(bytes(b for b, g in zip(raw, gone) if not g)))
    return [result[row] for row in texts]


def shingle_set(text: str | None, n: int) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < n else [tuple(w[i:i + n]) for i in range(len(w) - n + 1)])


def key(doc, text) -> bytes:
    return hashlib.md5(f"{'-' if doc is None else doc}:{text or ''}".encode()).digest()


def groups(rows: list[tuple], n: int, percent: int) -> list[int | None]:
    """For each row the number of its component, or null without shingles."""
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    return [find(i) if s else None for i, s in enumerate(sets)]


def components(rows: list[tuple], n: int, percent: int) -> list[tuple]:
    least: dict = {}
    found = groups(rows, n, percent)
    for (doc, _), root in zip(rows, found):
        if doc is not None and (least.get(root) is None or doc < least[root]):
            least[root] = doc
        least.setdefault(root, None)
    return [(doc, len(shingle_set(t, n)), doc if root is None else least[root]) for (doc, t), root in zip(rows, found)]


def line_windows(rows: list[tuple]) -> list[tuple]:
    def order(row):
        doc, text = row
        return (doc is not None, doc or 0, key(doc, text))

    spaces = " \t\n\x0b\x0c\r"
    texts = [(doc, t or "") for doc, t in rows]
    seen, result = set(), {}
    for doc, text in sorted(set(texts), key=order):
        lines = text.split("\n")
        full = [(i, s.strip(spaces)) for i, s in enumerate(lines) if s.strip(spaces)]
        gone = set()
        for k in range(len(full) - 2):
            window = tuple(s for _, s in full[k:k + 3])
            if window in seen:
                gone |= {i for i, _ in full[k:k + 3]}
            seen.add(window)
        kept = "\n".join(s for i, s in enumerate(lines) if i not in gone) if gone else text
        result[doc, text] = (doc, len(full), len(gone), kept)
    return [result[row] for row in texts]


def containments(rows: list[tuple], items: list[tuple], n: int = 5, percent: int = 80) -> list[tuple]:
    def grams(words, k):
        return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}

    words = lambda t: PLAIN.findall((t or "").lower())
    of_item: dict = {}
    for item, text in items:
        w = words(text)
        if w:
            of_item.setdefault(item, set()).update(grams(w, min(n, len(w))))
    out = set()
    for doc, text in set(rows):
        w = words(text)
        for item, own in of_item.items():
            shared = sum(g in grams(w, len(g)) for g in own) if len(own) < 4 else len(own & set().union(
                *(grams(w, k) for k in {len(g) for g in own})))
            if 100 * shared >= percent * len(own):
                out.add((doc, item, shared, len(own), text))
    return [r[:4] for r in out]
