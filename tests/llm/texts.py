"""Small tables with the awkward cases."""

ODD = [
    None,
    "",
    "   \n\t ",
    "one",
    "One two",
    "a b c d e f g h",
    "A B C D E F G H",
    "x" * 70_000,
    "same line here\nsame line here\nother\n\n\nsame line here\n" * 30,
    "café naïve \U0001f600\U0001f601 日本語。 \u0085   z",
    "it's  we'll   I'M\r\n\r\n  <|endoftext|> ### $$$ %%% && ||",
    "aaa aaaa aaaaa aaaaaa aaaaaaa abababababa ====================",
    "one two three four five six seven eight nine ten " * 12,
    "one two three four five six seven eight nine ten " * 12,
    "The Quick brown fox jumps over the lazy dog. " * 400,
    "=" * 60_000,
]


def documents(spark, texts=ODD, start=0):
    """doc_id, text and columns whose names clash with results."""
    rows = [(start + i, t, "en" if i % 2 else None, None if i % 3 else "src0", len(t or ""), -1, "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int, n_words string, sequence_id int")
