"""Fixed test rows."""

#: Edge cases that every operator must take: null, empty, blank, one word, no ASCII, very long, repeated rows, a null id.
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "日本語 ünïcode 🎉"), (6, "long text " * 30_000), (7, "same same"), (7, "same same"), (None, "no id at all"), (8, "x" * 50_000)]

#: Ids that a double cannot hold, beside a null one.
LARGE = [((1 << 53) + 1, "a large id"), ((1 << 62) + 7, "another large id"), (-(1 << 53) - 1, "a negative id"), (None, "a null id")]
