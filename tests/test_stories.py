"""Golden rows of extraction, labels, metrics, history and snapshots."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions import labels
from tidewire.functions.rows import with_index
from tidewire.operators import history, metrics, sentiment, topics
from tidewire.operators.graph import components
from tidewire.plans import queries
from tidewire.schemas import HISTORY, STORY, present, require
from tidewire.sources import snapshots, stories

T = datetime.datetime(2020, 9, 13, 12, 26, 40)


def test_extract_from_landed_json(spark, tmp_path):
    lines = [
        json.dumps({"id": 1, "title": "One", "score": 100, "descendants": 10, "time": 1600000000, "url": "http://a"}),
        json.dumps({"id": 2, "title": "Two"}),
        json.dumps({"id": 3, "title": None, "score": 5}),
        json.dumps({"id": 4, "score": 5}),
        "null",
        '{"id": 5, "title": "broken',
    ]
    (tmp_path / "items.json").write_text("\n".join(lines))
    items = stories.read_items(spark, str(tmp_path))
    rows = stories.extract(items).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [
        (1, "One", 100, 10, T, "http://a"),
        (2, "Two", 0, 0, datetime.datetime(1970, 1, 1), ""),
    ]
    assert stories.extract(items, keep_null_titles=True).count() == 4


def test_ranked_ids_before_details(spark, tmp_path):
    (tmp_path / "ids").mkdir()
    (tmp_path / "ids" / "top.json").write_text(json.dumps({"ids": list(range(10))}))
    ranked = stories.first_ranked(stories.read_ranked_ids(spark, str(tmp_path / "ids")), 5)
    items = spark.createDataFrame([(i, 10 * i) for i in range(10) if i != 3], "id long, score int")
    assert sorted(r.id for r in stories.attach_details(ranked, items).collect()) == [0, 1, 2, 4]


@pytest.mark.parametrize("limit", [5, 101, 12])
def test_story_limit_refused(limit):
    with pytest.raises(ValueError):
        stories.story_limit(limit)


def test_order_and_ties(spark):
    df = spark.createDataFrame([(3, 100), (1, 100), (2, 200)], "id long, score int")
    assert [r.id for r in stories.by_score(df).collect()] == [2, 1, 3]
    assert {r.id: r["index"] for r in with_index(df, F.desc("score"), F.col("id")).collect()} == {2: 0, 1: 1, 3: 2}


def test_labels_at_the_bounds(spark):
    values = [0.8, 0.5, 0.05, 0.0, -0.05, -0.5, -0.51]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    rows = df.select("s", labels.sentiment_label(F.col("s")).alias("l"), labels.sentiment_band(F.col("s")).alias("b")).collect()
    assert [r.l for r in rows] == ["Positive", "Positive", "Neutral", "Neutral", "Neutral", "Negative", "Negative"]
    assert [r.b for r in rows] == ["Very Positive", "Positive", "Neutral", "Neutral", "Negative", "Very Negative", "Very Negative"]


def test_display(spark):
    row = spark.createDataFrame([("t" * 81, "", "ai_ml_tech", 0.1875)], "title string, url string, k string, d double").select(
        labels.link(F.col("title"), F.col("url")).alias("link"),
        labels.shortened(F.col("title")).alias("short"),
        labels.topic_display(F.col("k")).alias("topic"),
        labels.similarity(F.col("d")).alias("s"),
        labels.explanation(F.lit(0.8125)).alias("e"),
        labels.snapshot_key(F.lit(30), F.lit("basic")).alias("key"),
    ).first()
    assert row.link == "t" * 81 and row.short == "t" * 80 + "..." and row.topic == "Ai Ml Tech"
    assert row.s == 0.812 and row.e == "Similarity: 81.2%" and len(row.key) == 32


def test_columns_required_and_present(spark):
    df = spark.createDataFrame([(1,)], "title int")
    with pytest.raises(ValueError, match="score"):
        require(df, "title", "score")
    assert present(df, "title", "url") == ["title"] and present(df, "x") == ["title"]


def test_sentiment_rules(spark):
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5), ("GREAT", 3.1)], "token string, valence double")
    cases = {
        "good": 1.9,
        "very good": 1.9 + 0.293,
        "very very good": 1.9 + 0.293 + 0.293 * 0.95,
        "slightly good": 1.9 - 0.293,
        "not good": 1.9 * -0.74,
        "not that very good": (1.9 + 0.293) * -0.74,
        "GREAT news": 3.1 + 0.733,
        "GREAT NEWS": 3.1,
        "good but bad": 1.9 * 0.5 - 2.5 * 1.5,
        "good!!": 1.9 + 2 * 0.292,
        "good!!!!!!": 1.9 + 4 * 0.292,
        "bad??": -2.5 - 2 * 0.18,
        "bad????": -2.5 - 0.96,
        "nothing here!": 0.0,
        "isn't good": 1.9 * -0.74,
        "isn\u2019t good": 1.9 * -0.74,
        "isnt good": 1.9 * -0.74,
        "they don't ever say it's good": 1.9,
        "don't say good": 1.9 * -0.74,
        "'good'": 1.9,
        "awfully good": 1.9 + 0.293,
        "kinda good": 1.9 - 0.293,
        "despite bad": -2.5 * -0.74,
    }
    rows = [(i, t) for i, t in enumerate(cases)] + [(90, None), (91, "")]
    found = {r.title: r for r in sentiment.score(spark.createDataFrame(rows, "id long, title string"), lexicon).collect()}
    for title, total in cases.items():
        assert found[title].sentiment_score == pytest.approx(round(total / (total * total + 15) ** 0.5, 4), abs=1e-4), title
    assert found[None].sentiment_score == found[""].sentiment_score == 0.0 and found[""].sentiment_label == "Neutral"


def test_kpis_and_top_topic(spark):
    rows = [(0.5, 10, "Quantum", 0), (-0.3, 20, "AI_Technology", 1), (0.1, 5, "Web", 2), (0.1, None, "Outlier/No Topic", -1)]
    df = spark.createDataFrame(rows, "sentiment_score double, descendants long, topic_keyword string, topic_id int")
    row = metrics.kpis(df).first()
    assert (row.average_sentiment, row.total_comments, row.top_topic, row.mood) == (0.1, 35, "AI_Technology", "Positive")
    empty = metrics.kpis(df.limit(0)).first()
    assert (empty.stories, empty.total_comments, empty.top_topic, empty.mood) == (0, 0, "No topics", None)
    odd = df.union(spark.createDataFrame([(0.0, 0, "No Data", -1)] * 3, df.schema))
    assert metrics.top_topic(odd).first()[0] == "AI_Technology"
    assert metrics.top_topic(odd, strict_labels=True).first()[0] == "No Data"


def test_topics_edge_cases(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, embedding array<float>")
    titles = spark.createDataFrame([(1, "rust code"), (2, "rust tools"), (3, "cooking"), (4, None), (5, "no vector")], "id long, title string")
    found = {r.id: (r.topic_id, r.topic_keyword) for r in topics.discover(titles, vectors, 0.9).collect()}
    assert found == {1: (0, "rust_code_tools"), 2: (0, "rust_code_tools"), 3: (-1, "Outlier/No Topic"), 4: (-1, "No Data"), 5: (-1, "Outlier/No Topic")}
    few = topics.discover(titles.where("id in (1, 4)"), vectors, 0.9).collect()
    assert {r.topic_keyword for r in few} == {"Insufficient Data"} and {r.topic_id for r in few} == {-1}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


def test_fingerprint_ignores_order(spark):
    rows = [(i, f" title {i % 7} ", i % 5, i, T, "") for i in range(200)]
    a = snapshots.fingerprint(spark.createDataFrame(rows, STORY)).first()[0]
    random.Random(1).shuffle(rows)
    b = snapshots.fingerprint(spark.createDataFrame(rows, STORY).repartition(7)).first()[0]
    c = snapshots.fingerprint(spark.createDataFrame(rows[:-1] + [(0, "other", 1, 1, T, "")], STORY)).first()[0]
    assert a == b != c


def test_snapshots(spark, tmp_path):
    kept = snapshots.Snapshots(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([(1, "a", 5, 0, T, "")], STORY)
    assert kept.load(30, "basic", 100.0) is None
    assert not kept.save(df.limit(0), 30, "basic", 100.0)
    assert kept.save(df, 30, "basic", 100.0) and kept.save(df.union(df), 30, "basic", 200.0)
    assert kept.load(30, "basic", 3799.0).count() == 2
    assert kept.load(30, "basic", 3800.0) is None and kept.load(50, "basic", 300.0) is None
    assert kept.load(30, "basic", 200.0, ttl_hours=0) is None
    (tmp_path / "s" / "manifest" / "broken.json").write_text("{not json")
    assert sorted((r.version, r.stories_count) for r in kept.manifests().collect()) == [(1, 1), (2, 2)]
    assert [r.valid for r in kept.catalogue(3750.0).orderBy("age_hours").collect()] == [True, False]


def test_index_validity(spark):
    check = lambda age, same=True, force=False: spark.range(1).select(snapshots.index_valid(F.lit(float(age)), F.lit(0.0), F.lit("x"), F.lit("x" if same else "y"), force)).first()[0]
    assert check(3600) and not check(3601) and not check(1, same=False) and not check(1, force=True)


def test_history(spark, tmp_path):
    new = spark.createDataFrame([(1, "a", 5, 0.1, "k", T), (2, "b", 6, 0.2, "k", T), (2, "later", 7, 0.2, "k", T + datetime.timedelta(1))], HISTORY)
    path = f"{tmp_path}/h"
    history.append(new, path)
    history.append(new.union(spark.createDataFrame([(3, "c", 1, 0.0, "k", T)], HISTORY)), path)
    assert sorted((r.id, r.title) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_stored_ids_are_read_alone(spark):
    """What is joined to the stored rows isn't made for their ids, and stored rows of one id ignore a new one once."""
    new = spark.createDataFrame([(1, "a", 5, 0.1, "k", T), (2, "b", 6, 0.2, "k", T)], HISTORY)
    scores = spark.createDataFrame([(1, 0.5)], "id long, other double")
    stored = new.where("id = 1").union(new.where("id = 1")).drop("sentiment_score").join(scores, "id", "left").withColumnRenamed("other", "sentiment_score")
    plan = history.not_stored(new, stored)
    assert [r.id for r in plan.collect()] == [2]
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_texts_are_not_dealt_by_topic(spark, small):
    def joins(node):
        below = [j for i in range(node.children().size()) for j in joins(node.children().apply(i))]
        return [node, *below] if node.nodeName() == "Join" else below

    by_topic = [j for j in joins(queries.enriched(spark, small)._jdf.queryExecution().optimizedPlan()) if "topic_id" in j.condition().toString()]
    assert by_topic and not any(c in j.output().toString() for j in by_topic for c in ("title", "text"))


def test_scores_of_some_stories(spark, small):
    """Texts that aren't asked for aren't scored, and others have the score that they have among all."""
    some = spark.createDataFrame([(i,) for i in (3, 50, 51, 50)], "id long")
    every = {r.id: r.sentiment_score for r in queries.lexicon_scores(spark, small).collect()}
    found = [tuple(r) for r in queries.lexicon_scores(spark, small, some).collect()]
    assert sorted(found) == [(i, every[i]) for i in (3, 50, 51)]
    assert sorted(r.id for r in queries.enriched_once(spark, small, some).collect()) == [3, 50, 51]


def test_exports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", title', 5, 0, T, "")], STORY)
    stories.export_csv(df, f"{tmp_path}/c")
    stories.export_json(df, f"{tmp_path}/j")
    assert spark.read.option("header", True).option("escape", "\\").csv(f"{tmp_path}/c").first().title == 'a "quoted", title'
    assert spark.read.json(f"{tmp_path}/j").first().time == "2020-09-13T12:26:40"


def test_sentiment_rules_like_brute_force(spark):
    """Random texts of the rules' words, against the rules word by word."""
    rng, lexicon = random.Random(5), {"good": 1.9, "bad": -2.5, "so": 0.7, "fine": 0.8}
    vocabulary = "good BAD bad GOOD so very VERY hardly isn't not but fine plain Plain NEVER kinda FINE".split()
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) for _ in range(60)]

    def want(text):
        words, total = text.split(), 0.0
        low = [w.lower() for w in words]
        mixed, but = len({w.isupper() for w in words}) == 2, low.index("but") if "but" in low else None
        for i, w in enumerate(words):
            v = lexicon.get(low[i])
            if v is None:
                continue
            sign = 1 if v > 0 else -1
            v += sign * 0.733 * (w.isupper() and mixed)
            for k, damping in ((1, 1.0), (2, 0.95), (3, 0.9)):
                if i >= k and low[i - k] not in lexicon:
                    step = 0.293 + 0.733 * (words[i - k].isupper() and mixed)
                    v += sign * damping * (step if low[i - k] in ("very", "so") else -step if low[i - k] in ("hardly", "kinda") else 0)
            for k in (1, 2, 3):
                v *= -0.74 if i >= k and low[i - k] in ("isn't", "not", "never") else 1
            total += v * (1 if but is None or i == but else 0.5 if i < but else 1.5)
        return total / (total * total + 15) ** 0.5

    df = spark.createDataFrame([*enumerate(texts), (1000, None)], "id long, title string")
    found = {r.id: r.sentiment_score for r in sentiment.score(df, spark.createDataFrame(list(lexicon.items()), "token string, valence double")).collect()}
    assert len(found) == 61 and found[1000] == 0.0
    assert all(abs(found[i] - want(t)) < 1e-4 for i, t in enumerate(texts))


def test_rules_act_with_a_derived_lexicon(spark):
    """Each kind of rule word changes a score, which it can't where it has a valence of its own."""
    base = "sun river"
    texts = [base, "very " + base, "barely " + base, "never " + base, "night but " + base, "night " + base, base + "!!", "SUN river"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, title string")
    lexicon = sentiment.derived_lexicon(df, without=sentiment.RULE_WORDS)
    assert not {r.token for r in lexicon.collect()} & set(sentiment.RULE_WORDS)
    got = {r.id: r.sentiment_score for r in sentiment.score(df, lexicon).collect()}
    assert len({got[i] for i in (0, 1, 2, 3, 6, 7)}) == 6 and got[4] != got[5]


def test_rules_need_no_window(spark):
    """Words look back within their text: the plan has no window, and factors are as stated."""
    from tidewire.operators import sentiment

    texts = spark.createDataFrame([(1, "very good but NOT a GOOD day"), (2, None), (3, "don't like it")], "id long, title string")
    valued = spark.createDataFrame([([],)], "valued array<string>")
    rows = {(r.id, r.token): [] for r in sentiment.factors(texts, valued).collect()}
    for r in sentiment.factors(texts, valued).collect():
        rows[r.id, r.token].append((round(r.times, 4), round(r.added, 4)))
    assert sorted(rows[1, "good"]) == sorted([(0.5, sentiment.BOOST), (round(1.5 * sentiment.NEGATED, 4), sentiment.CAPITALS)])
    assert rows[1, "but"] == [(1.0, round(sentiment.BOOST * sentiment.DAMPING[1], 4))] and rows[3, "like"] == [(sentiment.NEGATED, 0.0)] and {i for i, _ in rows} == {1, 3}
    lexicon = spark.createDataFrame([("good", 2.0)], "token string, valence double")
    assert "Window" not in sentiment.score(texts, lexicon)._jdf.queryExecution().optimizedPlan().toString()
