"""The corpus pipeline stage by stage, each judged on its own input."""

import base64
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from chronofact.llm import mixing
from chronofact.session import ROW, keyed, materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(spark):
    rng = random.Random(6)
    words = {"en": ["the", "cat", "and", "dog", "house", "this", "water", "with"], "de": ["der", "hund", "und", "katze", "haus", "dieses", "wasser", "mit"]}
    text = lambda lang, n: "\n".join(" ".join(rng.choice(words[lang]) + str(rng.randrange(50)) for _ in range(12)) for _ in range(n))
    rows = [(i, text(lang := ("en" if i % 3 else "de"), rng.randrange(2, 9)), lang, f"s{i % 4}") for i in range(90)]
    passage = text("en", 14)
    rows += [(200 + i, text("en", 3) + "\n" + passage + "\n" + text("en", 3), "en", "s0") for i in range(6)]
    rows += [(300, rows[1][1].replace("cat", "cats", 1), "en", "s1"), (301, "12345 !!", "en", "s1"), (302, None, "en", "s2"), (303, "", None, None)]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA), rows


def test_stages(spark):
    docs, rows = fixture(spark)
    seen = {}
    for name, stage in P.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, ""), "t")
        if name != "packing":
            assert docs.columns == before.columns
        seen[name] = docs
    ids = lambda n: sorted(r.doc_id for r in seen[n].select("doc_id").collect())
    assert ids("language_id") == sorted(r[0] for r in rows if r[0] not in (301, 302, 303))
    assert set(ids("line_dedup")) <= set(ids("language_id"))
    before = {r.doc_id: r.text for r in seen["language_id"].collect()}
    cut = {r.doc_id: r.text for r in seen["line_dedup"].collect()}
    assert sum(len(cut[i]) < len(before[i]) for i in cut if 200 <= i < 206) >= 4  # later copies of the passage
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"].collect())

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", t.lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    kept = ids("near_dedup")
    sets = {i: shingles(t) for i, t in cut.items()}
    for i in sorted(cut):
        twin = any(j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in cut)
        assert (i in kept) == (not twin)
    mixed = seen["mixing"].groupBy("doc_id").count().collect()
    assert {r.doc_id for r in mixed} <= set(kept) and max(r["count"] for r in mixed) <= 3
    pieces = seen["packing"].collect()
    assert sum(r.length for r in pieces) == sum(len(np.frombuffer(r.ids, dtype="<u4")) for r in pieces)
    assert {r.doc_id for r in pieces} == {r.doc_id for r in mixed}


def test_pipeline_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        docs = materialize(stage(spark, docs, ""), "t")
    assert docs.count() == 0


def test_line_stage_leaves_nothing_of_a_copy(spark):
    page = "\n".join(f"line {k} of the page" for k in range(60))
    docs = spark.createDataFrame([(1, page, "en", "s", 1), (2, page, "en", "s", 1)], SCHEMA)
    assert [(r.doc_id, r.text) for r in P.line_stage(spark, docs, "").collect()] == [(1, page)]


def test_language_stage_rejects_what_is_in_no_learned_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = [
        "Быстрая коричневая лиса прыгает через ленивую собаку и бежит домой в лес",
        "我们今天去公园散步然后回家吃饭看书睡觉",
        "ذهب الولد إلى المدرسة في الصباح الباكر مع أصدقائه",
        "Wczoraj poszedłem do sklepu, żeby kupić chleb i mleko, ale było już zamknięte",
        "Dün akşam arkadaşlarımla birlikte güzel bir film izledik",
        "Včera večer jsme šli do kina s přáteli",
        "Tối qua chúng tôi đã đi xem phim với bạn bè",
        base64.b64encode(random.Random(1).randbytes(60)).decode(),
        base64.b64encode(random.Random(2).randbytes(3000)).decode(),
        random.Random(3).randbytes(200).hex(),
        "a" * 500,
    ]
    more = spark.createDataFrame([(-1 - i, t, None, "s0", len(t)) for i, t in enumerate(odd)], SCHEMA)
    kept = {r.doc_id for r in P.language_stage(spark, docs.select(*more.columns).union(more), "").select("doc_id").collect()}
    assert not [t for i, t in enumerate(odd) if -1 - i in kept]
    clean = {r.doc_id: r.text for r in docs.where("text rlike '[A-Za-z]'").collect()}
    lost = [t for i, t in clean.items() if i not in kept]
    assert len(lost) <= 0.005 * len(clean)
    assert {i for i, t in clean.items() if 20 <= len(t) <= 60 and re.fullmatch(r"[\w .,]+", t)} <= kept


#: Sentences that nothing was trained on, in the four learned languages.
PLAIN = {
    "en": [
        "The committee met on Tuesday to review the budget.",
        "She left her keys on the kitchen table this morning.",
        "Rain is expected across the north by late afternoon.",
        "Our train was delayed because of a broken signal.",
        "He learned to play the piano when he was twelve.",
        "Most of the houses in this street were built of brick.",
        "Please return the library books before the end of May.",
        "The results of the study were published last week.",
        "I would like a cup of tea and a slice of bread.",
        "They walked along the river until it grew dark.",
        "Nobody knows who wrote this letter.",
        "We need more time to finish the work.",
    ],
    "de": [
        "Der Zug nach Hamburg hat heute zwanzig Minuten Verspätung.",
        "Meine Schwester arbeitet in einem Krankenhaus am Stadtrand.",
        "Wir haben gestern Abend einen langen Film gesehen.",
        "Die Kinder spielen im Garten hinter dem Haus.",
        "Bitte schließen Sie die Tür, bevor Sie gehen.",
        "Das Buch liegt auf dem Tisch neben der Lampe.",
        "Im Winter wird es hier schon am Nachmittag dunkel.",
        "Er hat den Schlüssel in seiner Tasche vergessen.",
        "Ich möchte ein Kilo Äpfel und etwas Käse kaufen.",
        "Niemand weiß, wann der Laden wieder öffnet.",
        "Am Montag beginnt die neue Ausstellung im Museum.",
        "Unser Hund schläft den ganzen Tag.",
    ],
    "fr": [
        "Le chien et le chat dorment devant la porte.",
        "Nous avons mangé dans un petit restaurant près du port.",
        "Elle travaille depuis dix ans dans la même entreprise.",
        "Il faut prendre le premier train demain matin.",
        "Les enfants jouent dans la cour de l'école.",
        "Je voudrais un café et deux croissants, s'il vous plaît.",
        "La réunion aura lieu mardi dans la grande salle.",
        "Mon frère a acheté une vieille maison à la campagne.",
        "On ne sait pas encore qui a gagné la course.",
        "Le vent souffle très fort sur la côte ce soir.",
        "Vous pouvez laisser votre manteau ici.",
        "Cette rivière traverse trois villages.",
    ],
    "es": [
        "El perro y el gato duermen en la cocina.",
        "Mañana vamos a visitar a mis abuelos en el pueblo.",
        "La biblioteca cierra a las ocho de la tarde.",
        "Mi hermana estudia medicina en la universidad.",
        "No encuentro las llaves del coche en ninguna parte.",
        "Los niños juegan al fútbol después de comer.",
        "Hace mucho calor en el sur durante el verano.",
        "Quisiera un vaso de agua y un poco de pan.",
        "El tren llegó con media hora de retraso.",
        "Nadie sabe quién escribió esta carta.",
        "Tenemos que terminar el trabajo antes del lunes.",
        "Las calles del centro estaban llenas de gente.",
    ],
}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_language_stage_keeps_plain_sentences(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = [t for ts in PLAIN.values() for t in [*ts, " ".join(ts), " ".join(ts) * 300]]
    more = spark.createDataFrame([(-1 - i, t, None, "s0", len(t)) for i, t in enumerate(texts)], SCHEMA)
    kept = {r.doc_id for r in P.language_stage(spark, docs.select(*more.columns).union(more), "").select("doc_id").collect()}
    assert len(texts) == 56 and [t for i, t in enumerate(texts) if -1 - i not in kept] == []


def test_near_and_mixing_stages_take_null_and_repeated_ids_as_rows(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, a), (None, a + " end"), (None, b), (7, c), (7, c), (7, d), (9, d), (8, e), (7, e), (3, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    near = P.near_stage(spark, docs, "")
    kept = [(r.doc_id, r.text) for r in near.collect()]
    assert len(kept) == 5 and {(3, b), (7, c), (7, d), (7, e)} <= set(kept)
    assert [t in (a, a + " end") for i, t in kept if i is None] == [True]
    rows = [(None, text()) for _ in range(40)] + [(5, text()) for _ in range(40)] + [(100 + i, text()) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    mixed = P.mixing_stage(spark, docs, "")
    # One source: its target is its size, so each row is taken once.
    assert mixed.columns == docs.columns and sorted(r.text for r in mixed.collect()) == sorted(t for _, t in rows)


def test_stages_keep_columns_of_any_name(spark):
    """Extra columns that have names the operators use inside, or make, come through as they are, row by row."""
    docs, rows = fixture(spark)
    extra = ["_id", "_copies", "_copy", "_letters", "_row_key", "_row", "_own", "score", "lang_pred", "lang_known", "lang_lead", "n_lines", "removed_lines", "size", "rank", "rate", "copies", "id", "sha", "lines", "stay", "gone", "_text", "_c0", "_other0", "component_id", "kept", "key", "n", "sig", "with space", "dot.ted"]
    wide = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in extra})
    for name, stage in P.STAGES:
        narrow, docs = sorted(map(str, (r.doc_id for r in stage(spark, docs, "").collect()))), docs
        out = materialize(stage(spark, wide, ""), "t")
        assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == narrow
        if name == "packing":
            break
        assert out.columns == wide.columns
        for r in out.collect():
            assert all(r[c] == f"{c}:{r.doc_id}" for c in extra)
        wide, docs = out, out.select(*docs.columns)


def test_stages_take_repeated_rows_and_null_ids(spark):
    """Each stage on repeated rows and null ids, against what plain counting says."""
    docs, rows = fixture(spark)
    rows = [r for r in rows if r[0] < 90]
    odd = [rows[1]] * 3 + [(None, *rows[5][1:])] * 2 + [(None, rows[7][1] + " more", "en", "s1"), (None, None, None, None)]
    many = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows + odd], SCHEMA)
    count = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    assert count(P.language_stage(spark, many, "")) == Counter(r[:2] for r in rows + odd if r[1])
    lines = count(P.line_stage(spark, many, ""))
    assert lines[rows[1][:2]] == 0 or lines[rows[1][:2]] == 4  # rows equal in id and text are one document
    near = count(P.near_stage(spark, many, ""))
    assert near[rows[1][:2]] == 1 and near[(None, rows[5][1])] == 0 and near[rows[5][:2]] == 1 and near[(None, None)] == 1
    assert all(n == 1 for n in near.values())
    mixed = count(P.mixing_stage(spark, many, ""))
    sample = mixing.systematic_sample(keyed(many), key_col=ROW)
    assert sum(mixed.values()) == sample.agg(F.sum("copies")).first()[0] and all(n <= 3 * (4 if k == rows[1][:2] else 2) for k, n in mixed.items())
    packed = P.packing_stage(spark, many, "").where("start = 0").collect()
    assert Counter(r.doc_id for r in packed) == Counter(r[0] for r in rows + odd)
