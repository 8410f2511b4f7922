"""Documents that hold every awkward case: nulls, empty and long texts, copies, repeated rows, extra columns with clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, salt int, queue string, fp string, part int, kept string, component_id string"

LONG = "word " * 30_000 + "the end"
TEXTS = [
    (0, "Alpha beta gamma delta epsilon"), (1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, "Alpha beta gamma delta epsilon"), (6, "alpha BETA gamma delta epsilon"), (7, "mail me: a.b@c.de or +1 (212) 555-0100"),
    (8, "déjà vu — 漢字 😀  x y"), (9, "token = 'abcdef123456'"), (10, "a\nb\na\n\na"), (None, "no id at all"), (None, "no id at all"), (12, "same row"), (12, "same row"), (13, "x" * 5000), (14, "<|endoftext|> is text"), (15, "don't 're  've\r\n\r\n  end "),
]


def rows():
    return [(d, t, "en" if d else None, None if d in (2, 4) else f"src{(d or 0) % 3}", None, "x", 1, "q", "f", 2, "k", "c") for d, t in TEXTS]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(t):
    return t or ""
