"""Small corpora and brute-force versions for the tests."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower_ascii(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def prose(r, n, width=12):
    letters = "abcdefghijklmnopqrstuvwxyzéüñ"
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, width))) for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with exact copies, edited copies, shared passages, repeated lines, blanks and nulls."""
    r = random.Random(seed)
    shared, line = prose(r, 60), "\n".join(prose(r, 8) for _ in range(4))
    texts = [prose(r, r.randint(1, 160)) for _ in range(n // 2)]
    while len(texts) < n - 6:
        base = r.choice(texts)
        kind = r.randrange(6)
        words = base.split(" ")
        if kind == 0:
            texts.append(base)
        elif kind == 1:
            for _ in range(1 + len(words) // r.choice((20, 40, 60))):
                words[r.randrange(len(words))] = prose(r, 1)
            texts.append(" ".join(words))
        elif kind == 2:
            texts.append(prose(r, 20) + " " + shared + "\n" + prose(r, 15))
        elif kind == 3:
            texts.append(prose(r, 9) + "\n" + line + "\n" + prose(r, 5))
        elif kind == 4:
            texts.append(re.sub(" ", "\t \n", base, count=3).upper())
        else:
            texts.append(base + " " + base)
    texts += [None, "", "  \n\t ", "ab ab ab " * 200, "é" * 500, prose(r, 4000)]
    r.shuffle(texts)
    return [(i, t, r.choice(("en", "de", None)), r.choice(("a", "a", "a", "b", None)), len(t or "")) for i, t in enumerate(texts)]


def messy(spark, rows):
    """The rows with more columns whose names operators use themselves."""
    extra = ("id", "norm", "bucket", "run", "key", "h", "rep", "row", "copies", "size", "gone", "leaks", "x", "label")
    df = spark.createDataFrame(rows, DOCS)
    for k, name in enumerate(extra):
        df = df.selectExpr("*", f"{k} as {name}")
    return df


def squash(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[squash(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        left = 1
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            out.append((i, keep, len(ids), bool(left and i == keep), hashlib.sha256(t.encode()).hexdigest()))
            left -= left and i == keep
    return out


def shingles(t, k):
    w = WORD.findall(lower_ascii(t or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near(rows, k, percent):
    """{id: (set size, component)}: every pair compared."""
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in ids}


def repeats(texts, length):
    """For each text: (bytes, removed, spans, rest)."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[j : j + length] for b in raw for j in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j : j + length] = [True] * length
        spans = sum(1 for j, g in enumerate(gone) if g and (not j or not gone[j - 1]))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def lines_left(rows):
    """{id: (text left, removed)} for unique ids."""
    seen, gone = set(), defaultdict(set)
    for i, t in sorted(rows):
        parts = (t or "").split("\n")
        for j in range(len(parts) - 2):
            win = tuple(parts[j : j + 3])
            if not "".join(win).strip(" "):
                continue
            if win in seen:
                gone[i] |= {j, j + 1, j + 2}
            seen.add(win)
    return {i: ("\n".join(p for j, p in enumerate((t or "").split("\n")) if j not in gone[i]), len(gone[i])) for i, t in rows}


def quality_vector(t):
    """The classifier's statistics of one text, byte by byte."""
    b = (t or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    n, w, lines = max(len(b), 1), max(len(words), 1), b.split(b"\n")
    count = lambda f: sum(1 for x in b if f(chr(x)))
    space = count(lambda c: c in " \t\n\x0b\x0c\r")
    punct = ".,;:?'\"()-"
    symbols = count(lambda c: c.isascii() and not c.isalnum() and c not in "!|" + punct + " \t\n\x0b\x0c\r")
    return [
        math.log1p(len(b)), (count(lambda c: "A" <= c <= "Z") / n) ** 0.5, (symbols / n) ** 0.5, (b.count(b"|") / w) ** 0.5, (count(lambda c: "0" <= c <= "9") / n) ** 0.5, (b.count(b"!") / w) ** 0.5,
        (count(lambda c: c in punct) / w) ** 0.5, math.log1p((len(b) - space) / w), space / n, 1 - len(set(lines)) / len(lines), math.log1p(len(b) / len(lines)),
        (sum(1 for x in words if 65 <= x[0] <= 90) / w) ** 0.5, (sum(1 for x, y in zip(words, words[1:]) if x == y) / w) ** 0.5,
    ]


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


def quality(rows, labels, shrink=0.1):
    """[(id, score)] of ``rows(id, text)``: class densities with numpy, from ``labels(id, label)`` outside the held-out fold."""
    x = [np.array(quality_vector(t)) for _, t in rows]
    by_id = defaultdict(list)
    for (i, _), v in zip(rows, x, strict=True):
        by_id[i].append(v)
    train = [np.array([v for i, y in labels if y == c and not held_out(i) for v in by_id[i]]) for c in (0, 1)]
    covs = [np.cov(v.T, bias=True) for v in train]
    pooled = np.maximum(sum(len(v) * np.diag(c) for v, c in zip(train, covs, strict=True)) / sum(map(len, train)), 1e-6)
    covs = [(1 - shrink) * c + shrink * np.diag(pooled) for c in covs]

    def density(v, c):
        d = v - train[c].mean(axis=0)
        return -0.5 * d @ np.linalg.solve(covs[c], d) - 0.5 * np.linalg.slogdet(covs[c])[1] + math.log(len(train[c]))

    return [(i, 1 / (1 + math.exp(-max(-40, min(40, density(v, 1) - density(v, 0)))))) for (i, _), v in zip(rows, x, strict=True)]


def hash64(*values):
    """Spark's xxhash64 of long values, signed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h - 2**64 if h >= 2**63 else h


CHAT_MARKERS = [re.compile(p) for p in (r"(?i)^\s*(?:#+\s*|\[)?system(?:\])?\s*:\s?", r"(?i)^\s*(?:#+\s*|\[)?(?:user|human|customer|q)(?:\])?\s*:\s?", r"(?i)^\s*(?:#+\s*|\[)?(?:assistant|ai|bot|a)(?:\])?\s*:\s?")]
CHAT_HEADS = [("System: ", "User: ", "Assistant: "), ("[system]: ", "Human: ", "AI: "), ("### System:\n", "### User:\n", "### Assistant:\n"), ("SYSTEM: ", "Q: ", "A: ")]


def chat_turns(rows, roles):
    """[(conv, turn_no, role, text)] from ``rows(conv, turn, role, text)`` of known roles and distinct turns: transcripts, counts and one Viterbi for each conversation."""
    convs = defaultdict(list)
    for conv, turn, role, text in sorted(rows):
        bare = turn > 0 and hash64(conv, turn) % 6 == 0
        raw = ("\n" if bare else CHAT_HEADS[hash64(conv) % 4][roles.index(role)]) + text
        convs[conv].append([(line, 2 * roles.index(role) + (at > 0)) for at, line in enumerate(raw.split("\n"))])

    def seen(line):
        marker = next((k + 1 for k, p in enumerate(CHAT_MARKERS) if p.search(line)), 0)
        size, end = len(line.strip(" ")), line.rstrip(" ")[-1:]
        return marker, int(bool(regex.search(r"^\s*\p{Lu}", line))), (size > 0) + (size >= 40) + (size >= 160), {"?": 2, ".": 1}.get(end, 0)

    start, step = np.full(6, 1e-3), np.full((6, 6), 1e-3)
    shown = [np.ones((6, n)) for n in (4, 2, 4, 3)]
    for r in range(3):
        step[2 * r, 2 * r + 1] += 1
        step[2 * r + 1, 2 * r + 1] += 1
        step[2 * r : 2 * r + 2, ::2] += 0.1
    pairs = set()
    for conv, turns in convs.items():
        if held_out(conv):
            continue
        start[turns[0][0][1]] += 1
        flat = [x for t in turns for x in t]
        for line, s in flat:
            for table, v in zip(shown, seen(line), strict=True):
                table[s, v] += 1
        for (_, a), (_, b) in zip(flat, flat[1:]):
            step[a, b] += 1
            if b % 2 == 0:
                pairs.add((a, b))
    for a, b in pairs:  # a step that is seen counts one more
        step[a, b] += 1
    start, step, shown = np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), [np.log(t / t.sum(axis=1, keepdims=True)) for t in shown]
    out = []
    for conv, turns in convs.items():
        lines = [line for t in turns for line, _ in t]
        best, back = None, []
        for line in lines:
            show = sum(t[:, v] for t, v in zip(shown, seen(line), strict=True))
            if best is None:
                best = start + show
            else:
                way = best[:, None] + step
                back.append(way.argmax(axis=0))
                best = way.max(axis=0) + show
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        made = []
        for k, (line, s) in enumerate(zip(lines, path, strict=True)):
            if not k or s % 2 == 0 or s // 2 != path[k - 1] // 2:
                made.append((roles[s // 2], []))
                for p in CHAT_MARKERS:
                    line = p.sub("", line)
                if not line.strip(" "):
                    continue
            made[-1][1].append(line)
        out += [(conv, k, role, "\n".join(text)) for k, (role, text) in enumerate(made)]
    return out


def tree(hashes):
    """Levels of digests, two by two, an odd last one alone."""
    rows = [hashes]
    while len(rows[-1]) > 1:
        rows.append([hashlib.sha256("".join(rows[-1][i : i + 2]).encode()).hexdigest() for i in range(0, len(rows[-1]), 2)])
    return rows


def siblings(rows, i):
    """(sibling or None, whether it stands left) for each level below the top."""
    return [(row[(i >> k) ^ 1] if (i >> k) ^ 1 < len(row) else None, (i >> k) & 1) for k, row in enumerate(rows[:-1])]


def merkle(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows in the order of ``DOCS``."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def leaf(i, t, lang, source, n):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)))

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, h, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            way = siblings(trees[g], i) + siblings(top, k)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            x = leaf(*r[:4], r[4] + 1) if bad else h
            for s, left in way:
                x = sha(x if s is None else s + x if left else x + s)
            out.append((r[0], h, trees[g][-1][0], top[-1][0], sha("".join(s for s, _ in way if s)), x, x == top[-1][0]))
    return out
