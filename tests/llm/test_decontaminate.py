import random
import re

from fixtures import SF, documents, odd_texts

from tariffloom.llm.decontaminate import find_contamination, flag_contamination, op10_decontamination, without_contamination

ITEM = "A train leaves the old station at 9 in the morning with 9 friends and travels 120 km to the town where Maria waits for them near the river."


def bench(spark, texts):
    return spark.createDataFrame([(100 + i, t, 1) for i, t in enumerate(texts)], "item_id long, text string, doc_id int")


def test_other_numbers_names_and_units_are_caught(spark):
    other = ITEM.replace("9", "7").replace("120 km", "85 miles").replace("Maria", "Peter")
    torn = ITEM.replace(" 9 in", " 7 in")
    docs = documents(spark, ["Some words before it. " + other + " And after.", torn, ITEM.upper(), ITEM, "A train leaves the old station.", *odd_texts()])
    got = {r.doc_id: r for r in find_contamination(docs, bench(spark, [ITEM, None, "", "one two"])).collect()}
    assert {0, 3} <= set(got) and got[0].item_ids == [100] and set(got) <= {0, 1, 2, 3}
    assert got[1].n_windows < got[3].n_windows  # windows with both nines don't match


def test_both_ways_of_joining_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    a = sorted(map(str, find_contamination(docs, items).collect()))
    b = sorted(map(str, find_contamination(docs, items, broadcast_bytes=-1).collect()))
    assert a == b and a


def test_query_finds_every_whole_item_and_little_else(spark):
    items = {r.item_id: re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: re.findall(r"\w+", (r.text or "").lower()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    runs = {}
    for i, w in items.items():
        for k in range(len(w) - 12):
            t = tuple(w[k : k + 13])
            runs[t] = min(i, runs.get(t, i))  # the least item stands for all with that window
    want = {d: sorted({runs[t] for k in range(len(w) - 12) if (t := tuple(w[k : k + 13])) in runs}) for d, w in docs.items()}
    rows = op10_decontamination(spark, SF).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: r.item_ids for r in rows} == want
    assert all(r.contaminated == bool(r.item_ids) for r in rows)


def test_short_items_and_empty_tables(spark):
    short = "The quick brown fox jumps over a lazy dog"
    docs = documents(spark, ["Well: the quick brown fox jumps over a lazy dog, they say.", "the quick brown fox"])
    assert [r.doc_id for r in find_contamination(docs, bench(spark, [short])).collect()] == [0]
    assert find_contamination(docs, bench(spark, [])).collect() == []
    assert flag_contamination(documents(spark, []), bench(spark, [short])).collect() == []
    out = without_contamination(docs, bench(spark, [short]))
    assert [r.doc_id for r in out.collect()] == [1] and out.columns == docs.columns


def test_verbatim_copies_with_few_literal_tokens(spark):
    items = ["Anna 3, Bert 4, Carl 5, Dora 6, Emil 7, Fred 8, Gina 9", "Compute 12 + 30 * 4 = ?", "Who is Ada?", "小明有五个苹果，他又买了三个，一共有几个？"]
    docs = documents(spark, [f"Some text before. {t} Some text after." for t in items] + ["前文" + items[3] + "后文", "Compute 12 + 30 * 5 = ? Who is it?", "Some Anna 4, Bert 4, Carl 5, Dora 6, Emil 7, Fred 8, Gina 9"])
    for options in ({}, {"broadcast_bytes": -1}):
        got = {r.doc_id: r.item_ids for r in find_contamination(docs, bench(spark, items), **options).collect()}
        assert {d: i for d, i in got.items() if d < 5} == {0: [100], 1: [101], 2: [102], 3: [103], 4: [103]} and 5 not in got


def test_names_at_sentence_starts(spark):
    item = "Anna buys 5 apples at the market. Anna sells 2 of them there. How many are left for her then?"
    renamed = item.replace("Anna", "Peter").replace("5", "8")
    docs = documents(spark, [renamed, item, renamed.replace("Peter sells", "Maria sells"), "Today " + item])
    got = {r.doc_id: r for r in find_contamination(docs, bench(spark, ["Anna buys 5 apples at the market. Anna sells 2 of them"])).collect()}
    assert sorted(got) == [0, 1, 3] and got[0].item_ids == [100]
    assert got[1].n_windows == got[0].n_windows == 1


def test_one_map_over_all_windows(spark):
    item = "A farmer has 12 cows in the barn by the river and each of the cows gives milk for the whole long summer so the farmer sells 12 cans of it"
    torn = item.replace("12 cans", "99 cans")
    other = item.replace("12", "30")
    docs = documents(spark, [item, torn, other])
    got = {r.doc_id: r.n_windows for r in find_contamination(docs, bench(spark, [item])).collect()}
    assert got[0] == got[2] > got[1] > 0


SLOTS = "mm km hours kg dollars"


def plain_template(text):
    """(template, own) tokens by loops: numbers, units after numbers, names inside sentences."""
    out, last, number_before = [], 0, False
    for m in re.finditer(r"[A-Za-z0-9%]+", text):
        word = m.group()
        opens = not out or any(c in ".!?\n:|" for c in text[last : m.start()])
        number = any(c.isdigit() for c in word)
        shout = sum(c.isupper() for c in word) > 1
        name = word[0].isupper() and not opens and not number and not shout
        unit = number_before and not opens and word.lower() in SLOTS.split()
        out.append(("#" if number else "U" if unit else "N" if name else word.lower(), word.lower(), opens and word[0].isupper() and not number and not shout))
        last, number_before = m.end(), number
    return out


def plain_windows(text, n):
    """Keys of all windows: both templates with the order of their slots, and own tokens."""
    tokens, keys = plain_template(text), set()
    for k in range(len(tokens) - n + 1):
        window = tokens[k : k + n]
        keys.add(("own", *[own for _, own, _ in window]))
        for names in (False, True):
            kinds = ["N" if names and opening else kind for kind, _, opening in window]
            slots = [own for kind, (_, own, _) in zip(kinds, window) if kind in "#UN"]
            if n - len(slots) >= max(3, (n + 1) // 2):
                keys.add((*kinds, *[slots.index(x) for x in slots]))
    return keys


def test_against_plain_templates(spark):
    rng = random.Random(4)
    words = "the a cow farm milk Anna Bert Carl 3 4 5 12 km kg hours gives takes . ? of and in sells".split()
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    items = [text(rng.randrange(13, 18)) for _ in range(8)]
    change = lambda t: " ".join({"3": "7", "4": "8", "Anna": "Dora", "km": "mm"}.get(w, w) for w in t.split())
    texts = [text(5) + " " + (change(rng.choice(items)) if k % 2 else rng.choice(items)) + " " + text(5) for k in range(20)] + [text(60) for _ in range(20)]
    keys = [plain_windows(t, 13) for t in items]
    want = {d for d, t in enumerate(texts) if any(plain_windows(t, 13) & k for k in keys)}
    for options in ({}, {"broadcast_bytes": -1}):
        got = {r.doc_id for r in find_contamination(documents(spark, texts), bench(spark, items), **options).collect()}
        assert got == want
