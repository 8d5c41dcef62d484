"""Plain models of the operators, a document at a time."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRIP = "\x20\t\n\x0b\x0c\r"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_stats(text):
    w, seen, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {i for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for i in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def shingle_set(text, k):
    w = words(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def components(rows, k, percent):
    """doc_id -> (set size, smallest linked doc_id)."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    held = collections.defaultdict(list)
    for a in sorted(sets):
        common = collections.Counter(b for s in sets[a] for b in held[s])
        for s in sets[a]:
            held[s].append(a)
        for b, n in common.items():
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def line_dedup(rows, min_docs=5, min_chars=40):
    """doc_id -> (lines, dropped, digest)."""
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(STRIP))
            if len(key) >= min_chars:
                held[key].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        keys = [lower(x.strip(STRIP)) for x in lines]
        kept = [x for x, k in zip(lines, keys) if not (len(held[k]) >= min_docs and max(held[k]) != i)]
        out[i] = len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()
    return out


def token_rows(rows, tokenizer):
    """doc_id -> ids with the end id."""
    return {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def unigram(rows, modulus, remainder):
    """doc_id -> (tokens, known, training tokens, base score)."""
    toks = {i: words(lower(t)) + [None] for i, t in rows}
    c = collections.Counter(w for i in toks if zlib.crc32(str(i).encode()) % modulus != remainder for w in toks[i])
    n, v = sum(c.values()), len(c)
    return {i: (len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, w in toks.items()}


def byte_stream(text, depth):
    return b"\n" * depth + " ".join(words(lower(text))).encode() + b"\n"


def suffix_tree(rows, modulus, remainder, depth, min_count, min_gain, mu):
    """doc_id to log10 probability: every context of every training text counted in dictionaries."""
    n = collections.defaultdict(collections.Counter)  # context to next bytes
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % modulus != remainder:
            stream = byte_stream(text, depth)
            for at in range(depth, len(stream)):
                for k in range(depth + 1):
                    n[stream[at - k : at]][stream[at]] += 1
    retained = set()
    for context, after in n.items():
        total, shorter = sum(after.values()), n[context[1:]]
        if context and total >= min_count:
            m = sum(shorter.values())
            if sum(c * math.log(c / total * m / shorter[x]) for x, c in after.items()) >= min_gain:
                retained.add(context)
    out, size = {}, sum(n[b""].values())
    for i, text in rows:
        stream, logs = byte_stream(text, depth), 0.0
        for at in range(depth, len(stream)):
            p = (n[b""][stream[at]] + 1) / (size + 256)
            for k in range(1, depth + 1):
                context = stream[at - k : at]
                if context in retained:
                    p = (n[context][stream[at]] + mu * p) / (sum(n[context].values()) + mu)
            logs += math.log10(p)
        out[i] = logs
    return out
