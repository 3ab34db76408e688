"""Hand-made documents with nulls, empty and long texts, ties, copies and clashing extra columns."""

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, h long, g long, k1 string, n int, text_id int"


def documents(spark, texts, first=0):
    rows = [(None if t == "no id" else first + i, None if t is None else t, None if i % 3 else "en", f"src{i % 2}" if i % 5 else None, None, 1, 2, "x", None, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EXTRA)


def odd_texts():
    base = " ".join(f"word{i}" for i in range(40))
    return [None, "", " \n\t ", "one", base, base, base + "  ", "x " + base, base.replace("word20", "other"), "a b é ü   c", "no id", "rep " * 60, "rep " * 60, " ".join(f"w{i * i % 9973}" for i in range(30000)), "z" * 200000]
