"""Small tables for the tests of the text operators."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, size=5):
    own = words(text)
    return {tuple(own[i:i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()


def prose(seed, n, kinds=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "site", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)
