from terrafold.llm.line_dedup import line_dedup, line_dedup_texts

from .helpers import DOCS, doc_rows


def brute(rows, window=3):
    """(doc_id, text) -> cleaned text; rows are distinct."""
    key = lambda r: (r[0] is not None, r[0] or 0)  # noqa: E731  null ids first
    seen, out = set(), {}
    for r in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=key):
        lines = r[1].split("\n")
        trimmed = [x.strip(" \t\n\x0b\x0c\r") for x in lines]
        gone = set()
        for i in range(len(lines) - window + 1):
            w = tuple(trimmed[i : i + window])
            if not any(w):
                continue
            if w in seen:
                gone |= set(range(i, i + window))
            seen.add(w)
        out[r] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def check(spark, rows):
    got = line_dedup_texts(spark.createDataFrame(rows, DOCS)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(str((r[0], want.get((r[0], r[1])))) for r in rows)


def test_against_brute_force(spark):
    p = "alpha\nbeta\ngamma\ndelta"
    rows = [
        (1, f"head\n{p}\ntail", "", "", 0),
        (2, f"{p}", "", "", 0),
        (3, f"x\n  beta \ngamma\t\ndelta\ny", "", "", 0),
        (4, "a\nb\na\nb\na\nb", "", "", 0),
        (5, "same\nsame\nsame\nsame\nsame", "", "", 0),
        (6, "\n\n\n\n", "", "", 0),
        (7, "beta\ngamma", "", "", 0),
        (8, f"new\nhead\n{p}", "", "", 0),
    ]
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, doc_rows())


def test_repeated_rows_share_their_fate_and_names_may_clash(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 9, "t"), (1, "a\nb\nc", 8, "t"), (2, "z\na\nb\nc", 7, "t")], "doc_id long, text string, n_lines long, text_hash string")
    got = line_dedup(df)
    assert got.columns == ["doc_id", "text", "n_lines", "text_hash", "_n_lines", "n_removed"]
    assert sorted((r["doc_id"], r["text"], r["n_lines"]) for r in got.collect()) == [(1, "a\nb\nc", 8), (1, "a\nb\nc", 9), (2, "z", 7)]
    assert line_dedup(spark.createDataFrame([], DOCS)).count() == 0
