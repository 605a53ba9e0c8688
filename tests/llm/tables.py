"""Small tables with everything that is awkward: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import re

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "_id string, _text string, _n bigint, kept string, shard string, n_words string, _row string, _scan string")
SPACE = re.compile(r"[\x20\x09-\x0D]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
STORY = " ".join(f"word{i} tale{i % 7}" for i in range(40))

TEXTS = [
    (1, "Shared line of text\nown line one\n\nshort"), (2, " shared LINE of text\t\nShared line of text\nown line two"), (3, None), (4, ""),
    (5, "\n\n"), (6, STORY), (7, STORY.replace("word3 ", "Word3  ")), (8, STORY + " extra"), (9, STORY.replace("word20", "changed")),
    (10, "x"), (11, "X"), (12, "a b c"), (13, "A  b\nc"), (14, "12 34 !? 56"), (15, "ÀÉ straße ünïcode Ñandú \U0001F600 text"),
    (16, "long words " * 6000 + "\nShared line of text"), (16, "another text of the same id, told apart"), (None, "no id but a text of its own"),
    (None, STORY), (10, "x"), (10, "x"), (6, STORY), (17, "tab\x0bform\x0creturn\rline"), (18, "tabformreturnline"), (-5, "Own line two"),
]


def docs(spark, texts=TEXTS):
    rows = [(i, t, ("en", "fr", None)[k % 3], ("a", "b", None)[k % 3], 7, "clash", "clash", 1, "clash", "clash", "clash", "clash", "clash")
            for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def lower(text):
    return (text or "").translate(LOWER)
