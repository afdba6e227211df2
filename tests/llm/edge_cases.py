"""Odd documents that every operator has to take: (doc_id, text, source)."""

EDGES = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (4, "one", "b"), (None, "one two", None), (5, "one two three " * 400, "a"),
    (6, "x" * 30_000, "b"), (7, "Zwölf große Bären — ﬁ 𝟙\x00\x1f end. " * 20, "c"), (8, "one two three " * 400, "c"), (9, "A\nB  C\r\nD", "a"),
]
