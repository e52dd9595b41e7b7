import numpy as np
import pytest

from heddle.llm import pii
from heddle.llm.gbdt import Boosted, threshold
from tests.llm import pii_held_out

NAMES = ["Solen", "Yvela", "Miran", "Kala", "Dorik", "Elsa", "Tovan", "Runa", "Jorik", "Helen", "Nadya", "Fenik"]


@pytest.fixture(scope="module")
def detector():
    return pii.Detector(NAMES)


def values(detector, text):
    return {(k, text[a:b]) for k, a, b in detector.detect([text])[0]}


YES = [
    ("Contact: solen.vreesh@mail.example; ask us", ("email", "solen.vreesh@mail.example")), ("Write to <miran+tools [at] post [dot] invalid> for access.", ("email", "miran+tools [at] post [dot] invalid")), ("Escribir a kala_dun AT inbox DOT corp DOT example. See", ("email", "kala_dun AT inbox DOT corp DOT example")),
    ("| mobile | +1-816-555-0117 ext. 494 |", ("phone", "+1-816-555-0117 ext. 494")), ("Tél. : 0033199 00 43 15;", ("phone", "0033199 00 43 15")), ("fax 030/23125220; pager off", ("phone", "030/23125220")), ("Call +44 (0)7700 900 959 during the outage.", ("phone", "+44 (0)7700 900 959")),
    ("The form shows national id QQ 91 22 47 B.", ("id_number", "QQ 91 22 47 B")), ("SSN 937-84-2409 was pasted into the log.", ("id_number", "937-84-2409")), ("Steuer-ID 02 353 430 031;", ("id_number", "02 353 430 031")),
    ("She moved to Flat 38, 177 Quillan Close, Kaltenhof QX0 0ZZ. Then", ("address", "Flat 38, 177 Quillan Close, Kaltenhof QX0 0ZZ")), ("Office: 2 bis, rue des Clovers, 00821 Puertosol;", ("address", "2 bis, rue des Clovers, 00821 Puertosol")), ("Adresse : Winderstr. 148b, 00607 Ashcombe;", ("address", "Winderstr. 148b, 00607 Ashcombe")), ("Anschrift: Calle del Ossen 80, 6.º B, 00545 Brévannes.", ("address", "Calle del Ossen 80, 6.º B, 00545 Brévannes")),
    ("Dr. Yvela H. Kestraura signed the report.", ("person", "Yvela H. Kestraura")), ("Reviewer: Marquiberg, Kala;", ("person", "Marquiberg, Kala")), ("@hutch: Ms S. Brimmendahl called back;", ("person", "S. Brimmendahl")), ("cc Solen HALDORSKI;", ("person", "Solen HALDORSKI")),
]
NO = ["install @tallowby/poller@1.12.4 or resolver@latest", "git clone git@code.loft.invalid:tools/poller.git && cd cache", "Ticket 5512-0043-91 was merged into 5512-0044-02.", "ports 4221-9179, build 202602.212.2, trace e7663c422c1b7c75", "Kala 3.18.6 replaces the graph adapter.", "The Solen connector reached 56.", "# registry-Dorik\n\nInstall 3.3.6, then read policy.toml.", "Call stack depth 240, frame 0xf9177aa994175bab.", "Die Regel rule 002 fires.", "phone: +XX XXX XXX"]


@pytest.mark.parametrize(("text", "want"), YES)
def test_found_as_written(detector, text, want):
    assert values(detector, text) == {want}


@pytest.mark.parametrize("text", NO)
def test_look_alikes_are_left(detector, text):
    assert values(detector, text) == set()


def test_names_inside_addresses_are_no_persons_and_spans_never_overlap(detector):
    text = "Mail Kala.Vreeshberg@mail.example if Runa Dunmoez is away. " * 50
    spans = detector.detect([text])[0]
    assert {text[a:b] for k, a, b in spans if k == "email"} == {"Kala.Vreeshberg@mail.example"} and "Kala.Vreeshberg" not in {text[a:b] for k, a, b in spans if k == "person"}
    assert all(x[2] <= y[1] for x, y in zip(spans, spans[1:], strict=False))


def test_table_with_nulls_empty_and_long_texts(spark):
    long = "nothing here; " * 20_000 + "cc Solen Haldorski;"
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "x"), (4, "cc Solen Haldorski; cc Solen Haldorski;", "x"), (4, "cc Solen Haldorski;", "x")]
    schema = "doc_id long, text string, found string"
    names = spark.createDataFrame([(n,) for n in [*NAMES, None]], "given_name string")
    df = pii.scan_texts(spark.createDataFrame(rows, schema), names)
    assert sorted(tuple(r) for r in pii.cases(df).collect()) == [(3, "person", "Solen Haldorski"), (4, "person", "Solen Haldorski")]
    out = {(r["doc_id"], r["redacted"]) for r in df.collect()}
    assert (1, None) in out and (2, "") in out and (4, "cc [PERSON];") in out and any(d == 3 and t.endswith("cc [PERSON];") for d, t in out)
    assert pii.scan_texts(spark.createDataFrame([], schema), names.limit(0)).count() == 0


def measured(detector, cases):
    """{type: (recall, precision)} of (text, [(type, value)])."""
    hit, found, truth = ({k: 0 for k in pii.TYPES} for _ in range(3))
    for text, want in cases:
        got = values(detector, text)
        for k in pii.TYPES:
            g, w = {x for x in got if x[0] == k}, {x for x in want if x[0] == k}
            hit[k], found[k], truth[k] = hit[k] + len(g & w), found[k] + len(g), truth[k] + len(w)
    return {k: (hit[k] / truth[k], hit[k] / max(1, found[k])) for k in pii.TYPES}


@pytest.mark.parametrize(("cases", "precision"), [(pii_held_out.cases(), 0.95), (pii_held_out.cases_b(), 0.85)])
def test_recall_on_frames_and_values_no_model_has_seen(detector, cases, precision):
    got = measured(detector, cases)
    assert all(r >= 0.9 and p >= precision for r, p in got.values()), got


def test_made_sentences_of_another_seed():
    import random

    words = pii.ordinary_words()
    d = pii.Detector(NAMES, words, seed=1)
    made = pii._made(random.Random(99), sorted(NAMES), sorted(w for w in words if w.isascii() and len(w) > 3))[:2000]
    got = measured(d, made)
    assert all(r > 0.93 and p > 0.9 for r, p in got.values()), got


def test_training_sentences_are_not_the_corpus_own():
    """No lead or tail of more than eight characters stands in the documents."""
    import duckdb

    phrases = [x for v in pii.LEADS.values() for x in v] + [x for v in pii.TELLS.values() for x in v] + list(pii.PERSON_TAILS)
    phrases = sorted({p.strip().lower() for p in phrases if len(p.split()) >= 2 and len(p) > 8})
    docs = duckdb.sql("SELECT lower(text) FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()
    text = "\n".join(d for (d,) in docs)
    assert [p for p in phrases if p in text] == []


def test_long_local_parts_and_partial_addresses(detector):
    local = "a.b" * 100
    assert values(detector, f"cc {local}@mail.example today") == {("email", f"{local}@mail.example")}
    assert values(detector, "é" + "x" * 5 + "@mail.example") == set()  # its first letter is none an address has
    assert values(detector, "@" * 1000 + "a@" * 1000) == set()


def test_large_lexicons_are_refused(spark, monkeypatch):
    monkeypatch.setattr(pii, "LEXICON_BYTES", 3)
    with pytest.raises(ValueError):
        pii.scan_texts(spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([("Helen",)], "given_name string"))


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = Boosted(trees=30, depth=3).fit(x[:1500], y[:1500])
    p = model.probability(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.95
    assert 0 < threshold(p, y[1500:]) < 1
