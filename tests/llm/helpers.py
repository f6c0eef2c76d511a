"""Small tables with everything that may go wrong, and brute-force word lists."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: documents' columns, and others whose names the operators use inside.
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, _id string, words string, shard int, key string, _text string, part int, label string"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def docs_frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1]) if r[1] else None, 7, "x", None, 1, "k", None, 2, "l") for r in rows]
    return spark.createDataFrame(full, DOCS)


LONG = " ".join(f"w{i % 977} q{i % 13}" for i in range(60_000))
NASTY = [
    (1, "Released under the MIT License.\nAll good."),
    (1, "Released under the MIT License.\nAll good."),  # a repeated row
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "!!! ??? ###"),
    (6, "a"),
    (7, LONG),
    (8, LONG + " tail"),
    (None, "a row without an id but with some words in it"),
    (9, "“漢字” ümläut éé 12,5 <|endoftext|> it's we'll 'tis x\u0085y\x0bz"),
    (10, "\x00\x01 odd ퟿ bytes"),
]
