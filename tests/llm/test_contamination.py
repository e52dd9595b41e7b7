import random

import pytest

from heddle.llm import contamination as c

ITEM = "If the map adapter waits 45 seconds for Helen before version 3.12.4 ships, which keeper of the seal would object first and why"
NAMES = ["Helen", "Dora", None]


def frames(spark, docs, items=((1, ITEM),)):
    return (
        spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, w string, at int"),
        spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, at string"),
        spark.createDataFrame([(n,) for n in NAMES], "given_name string"),
    )


def found(spark, docs, items=((1, ITEM),)):
    return {tuple(r) for r in c.leaked_items(c.template_matches(*frames(spark, docs, items))).collect()}


@pytest.mark.parametrize("limit", [-1, c.SIFT_BYTES])
def test_thirteen_words_in_any_case_and_punctuation(spark, monkeypatch, limit):
    monkeypatch.setattr(c, "SIFT_BYTES", limit)
    words = ITEM.replace(",", "").replace(".", " ").split()
    rng = random.Random(2)
    noise = " ".join(rng.choice(["alpha", "é", "9", "seconds"]) for _ in range(3000))
    docs = [
        (1, "Said: " + " ".join(words[3:16]).upper()), (2, " ".join(words[3:15])), (3, "** ".join(words[:13]) + "!"), (4, None), (5, ""), (6, noise + " " + ITEM + " " + noise),
        (7, " ".join(words[:12]) + " x " + " ".join(words[12:24])), (8, ITEM.replace("45", "46")), (1, ITEM), (None, ITEM), (9, "_".join(words)),
    ]
    assert found(spark, docs) == {(1, 1), (3, 1), (6, 1), (9, 1), (8, 1)} - ({(8, 1)} if len(words[8:]) < 13 else set())


def test_brute_force_on_random_words(spark):
    rng = random.Random(9)
    vocabulary = ["a", "b", "3", "7", "days"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(30)) for i in range(4)]
    docs = []
    for i in range(30):
        it = items[i % 4][1].split()
        a = rng.randint(0, 20)
        docs.append((i, text(10) + " " + " ".join(it[a : a + rng.randint(8, 16)]) + " " + text(10)))
    grams = lambda t: {tuple(t.split()[k : k + 13]) for k in range(len(t.split()) - 12)}
    assert found(spark, docs, items) == {(d, i) for d, t in docs for i, s in items if grams(t) & grams(s)}


def test_other_numbers_names_and_units_are_reparameterised_if_consistent(spark):
    twice = "Add 5 days and 5 days then 8 days for Helen who waits"
    docs = [(1, twice.replace("5", "6").replace("Helen", "Dora")), (2, twice.replace("5 days and 5", "6 days and 7")), (3, twice), (4, twice.replace("days", "hours"))]
    got = {(r["doc_id"], r["kind"]) for r in c.reparameterised(*frames(spark, docs, [(1, twice)])).collect()}
    assert (1, "reparameterised") in got and (3, "verbatim") in got and (4, "reparameterised") in got and 2 not in {d for d, _ in got}


def test_empty_tables_and_short_items(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, ITEM)], []) == set()
    assert found(spark, [(1, "a b c")], [(1, "a b c"), (2, None)]) == set()


def test_numbers_are_of_category_n_in_every_script():
    slots = {w: c.slot_of(w, frozenset(["helen"])) for w in ("45", "٣٤", "ⅷ", "½", "三", "4a", "kg", "helen", "x")}
    assert slots == {"45": 1, "٣٤": 1, "ⅷ": 1, "½": 1, "三": 0, "4a": 0, "kg": 2, "helen": 3, "x": 0}


def brute(docs, items, names, size):
    """Every pair of windows compared word by word."""

    def windows(text):
        ws = c.words(text)
        return [ws[k : k + size] for k in range(len(ws) - size + 1)]

    low, out = frozenset(n.lower() for n in names if n), {}
    for d, t in docs:
        for i, s in items:
            for x in windows(t):
                for y in windows(s):
                    kinds = [(c.slot_of(a, low), c.slot_of(b, low)) for a, b in zip(x, y, strict=True)]
                    if all(p == q and (p or a == b) for (p, q), a, b in zip(kinds, x, y, strict=True)):
                        pairs = {(a, b) for a, b in zip(x, y, strict=True)}
                        if len(pairs) == len(set(x)) == len(set(y)):
                            n = out.setdefault((d, i), [0, 0])
                            n[0] += 1
                            n[1] += x == y
    return {(d, i, n, v, "verbatim" if v else "reparameterised") for (d, i), (n, v) in out.items()}


@pytest.mark.parametrize("limit", [-1, c.SIFT_BYTES])
def test_sifted_or_not_the_result_is_the_same(spark, monkeypatch, limit):
    monkeypatch.setattr(c, "SIFT_BYTES", limit)
    rng = random.Random(20)
    vocabulary = ["map", "三", "四", "ⅷ", "3", "45", "٣", "Helen", "DORA", "days", "kg", "Straße", "İx", "é"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(9)) for i in range(6)]
    docs = [(i, text(6) + "; " + " ".join(w if rng.random() < 0.7 else rng.choice(vocabulary) for w in items[i % 6][1].split()) + "_" + text(5)) for i in range(40)]
    got = [tuple(r) for r in c.reparameterised(*frames(spark, docs, items), size=5).collect()]
    want = brute(docs, items, NAMES, 5)
    assert len(got) == len(want) and set(got) == want and {w[4] for w in want} == {"verbatim", "reparameterised"}


def test_one_pass_over_the_texts_and_no_text_in_an_exchange(spark, sf, capsys):
    from heddle.llm import queries

    queries.p8_leaks(spark, sf).explain()
    plan = capsys.readouterr().out
    assert plan.count("documents.parquet") == 1 and plan.count("MapInArrow") == 2
    for line in plan.splitlines():
        assert not ("Exchange" in line and "text" in line)


def test_large_lexicons_are_refused_and_memory_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(c, "LEXICON_BYTES", 3)
    with pytest.raises(ValueError):
        found(spark, [(1, ITEM)])
    monkeypatch.setattr(c, "REMEMBERED", 5)
    monkeypatch.setattr(c, "AT_ONCE", 3)
    reader = c.Reader([], 3)
    a = [w[2].tolist() for w in reader.windows(["a b c d e f g h"])]
    assert a == [w[2].tolist() for w in reader.windows(["a b c d e f g h"])] and [len(x) for x in a] == [3, 3]
