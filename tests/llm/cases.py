"""Rows that every operator must take."""

#: Nulls, empty and long texts, ties, repeated rows, an extra column with a clashing name.
HARD = [
    (1, None, "a"),
    (2, "", "b"),
    (3, "   \n\t ", "c"),
    (4, "x" * 30000, None),
    (5, "same words in this very short text", "d"),
    (5, "same words in this very short text", "d"),
    (6, "same words in this very short text", "e"),
    (None, "same words in this very short text", "f"),
    (7, "é" * 9000 + " ü " + "1" * 9000 + "!" * 5000, "g"),
    (8, ("word " * 20000).strip(), "h"),
    (9, "<|endoftext|> middle <|endoftext|>", "i"),
    (10, "one two", "j"),
    (11, "ONE two", "k"),
]
HARD_SCHEMA = "doc_id long, text string, ids string"
