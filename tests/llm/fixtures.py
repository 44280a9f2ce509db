"""Small awkward tables and plain-Python versions of what the operators must return."""

import collections
import hashlib
import itertools
import random
import re

from pyspark.sql import types as T

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
ALNUM = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
CLASHES = ["_row", "size", "n_words", "kept", "score", "component_id", "words", "block", "labels", "text2"]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(n))


def awkward_texts(seed=5):
    rng = random.Random(seed)
    base = [sentence(rng, n) for n in (3, 5, 60, 80, 200)]
    near = [base[3] + " tail", "head " + base[3], base[3].replace(" ", "  ", 3), base[4] + " x y z"]
    lines = ["same long line here\nother " + sentence(rng, 4), "  SAME long line here \n\nshort", "same long line here\nsame long line here", "\n\n\n"]
    odd = [None, "", " ", "\n", "A", "a", "É é   İ", "tab\tand\x0bvt\x0cff\rcr", "word " * 300, "# * $ % & | < >", "123 456", "<|endoftext|> in text", "\x00 nul", "漢字かな 交じり", sentence(rng, 20_000)]
    licences = ["Released under the MIT License. Also CC BY 4.0!", "GNU General Public License, version 3; gnu general public license", "Apache License, Version 2.0 and cc-by", "mit mit license license", "cc", "the apache"]
    return base + near + [base[3], base[4]] + lines + odd + licences


def documents(spark, texts=None, extra=True):
    """Documents with ids, texts, languages and sources; repeated rows and, if asked for, columns whose names clash."""
    texts = awkward_texts() if texts is None else texts
    rows = [(i * 3 + 1, t, ("en", "fr", None)[i % 3], ("b", "a", "c", None)[i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += rows[2:4]  # whole rows again
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    if extra:
        rows = [r + ("?",) * len(CLASHES) for r in rows]
        fields += [T.StructField(c, T.StringType()) for c in CLASHES]
    return spark.createDataFrame(rows, T.StructType(fields)).repartition(3)


def as_pairs(df):
    return sorted({(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()}, key=str)


def shingles(text):
    words = WORD.findall((text or "").encode().lower())
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def brute_base(text):
    raw = (text or "").encode()
    words = WORD.findall(raw)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x.encode())]
    return len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def brute_hits(text, items, window=10):
    words = ALNUM.findall(low(text))
    hit, found = set(), set()
    for item_id, item in items:
        own = ALNUM.findall(low(item))
        n = min(window, len(own))
        grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(str(item_id))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def brute_lines(rows, min_chars=10, min_docs=2):
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < min_docs or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out
