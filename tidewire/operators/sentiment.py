"""Sentiment of short texts from a lexicon table.

The compound score is the sum of the valences of a text's words, adjusted
by rules, and brought into -1 to 1 by ``s / sqrt(s * s + 15)``. The rules
follow the published description (Hutto and Gilbert, 2014): boosters and
negations among the three words before, capitals for emphasis, ``but``,
exclamation and question marks.

All of it is DataFrame work. The rules need the valence of no word but the one that they act on,
besides which boosters and dampers have one; so words look back within the array of their
text's words, and each becomes a row with its factors, which is then joined with the lexicon: no window,
and the words of a text needn't come together again, only its sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import sentiment_label
from ..functions.tokens import TERM as WORD
from ..functions.tokens import terms
from ..schemas import require

# Fixed values of the published rules.
ALPHA = 15.0
BOOST, CAPITALS, NEGATED = 0.293, 0.733, -0.74
DAMPING = (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, EXCLAMATIONS = 0.292, 4
QUESTION, QUESTIONS_MOST = 0.18, 0.96
BOOSTERS = """absolutely amazingly awfully completely considerable considerably decidedly deeply effing enormous enormously entirely especially
exceptional exceptionally extreme extremely fabulously flippin flipping frackin fracking frickin fricking friggin frigging fully greatly hella highly
hugely incredible incredibly intensely major majorly more most particularly purely quite really remarkably so substantially thoroughly total totally
tremendous tremendously uber unbelievably unusually utter utterly very""".split()
DAMPERS = "almost barely hardly kinda kindof less little marginal marginally occasional occasionally partly scarce scarcely slight slightly somewhat sorta sortof".split()
NEGATIONS = """aint arent cannot cant couldnt darent despite didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neednt neither never no nobody none
nope nor not nothing nowhere oughtnt rarely seldom shant shouldnt uhuh wasnt werent without wont wouldnt""".split()

#: For the rules, words keep the apostrophes inside them: ``isn't`` is one.
SPOKEN = r"[^\p{L}0-9']+"


def spoken(text: Column) -> Column:
    """Words in order, with apostrophes inside them, straight ones for all spellings."""
    plain = F.translate(text, "\u2019\u02bc", "''")
    return F.filter(F.transform(F.split(plain, SPOKEN), lambda w: F.regexp_replace(w, "^'+|'+$", "")), lambda w: w != "")


def words(texts: DataFrame, id_col: str = "id", text_col: str = "title") -> DataFrame:
    """``(id, place, word)``: the words of each text in their own spelling."""
    found = texts.select(F.col(id_col).alias("id"), F.posexplode(F.filter(F.split(F.col(text_col), WORD), lambda w: w != "")).alias("place", "word"))
    return found


#: Words that rules act by; with a valence of their own, boosters and dampers wouldn't act.
RULE_WORDS = [*BOOSTERS, *DAMPERS, *NEGATIONS, "but"]


def derived_lexicon(texts: DataFrame, text_col: str = "title", without: list[str] | None = None) -> DataFrame:
    """A stand-in lexicon for invented prose: a valence from -4 to 4 by spelling, but none for the words ``without``."""
    tokens = texts.select(terms(F.col(text_col)).alias("token")).where("token <> ''")
    kept = tokens.where(~F.col("token").isin(without)) if without else tokens
    return kept.distinct().select("token", spelled_valence(F.col("token")).alias("valence"))


def spelled_valence(token: Column) -> Column:
    """The valence that ``derived_lexicon`` gives a word."""
    return ((F.length(token) + F.ascii(token)) % 9 - 4).cast("double")


def compound(total: Column) -> Column:
    score = F.round(total / F.sqrt(total * total + ALPHA), 4)
    return F.when(total.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)))


def _made(rows: DataFrame, name: str, column: Column) -> DataFrame:
    """``rows`` with a column that is made once a row: an expression would be made anew for each element that looks back into it."""
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(column)).alias(name))


def factors(texts: DataFrame, valued: DataFrame, id_col: str = "id", text_col: str = "title") -> DataFrame:
    """``(id, token, times, added)``: for each word of a text what is added to its valence with the valence's
    sign, and by what both are multiplied. ``valued(valued)``: a row with the boosters and dampers that have a valence."""
    rows = _made(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("words")), "words", spoken(F.col("words")))
    rows = rows.join(F.broadcast(valued), F.lit(True))  # one row

    def mark(w: Column) -> Column:
        token = F.lower(w)
        step = F.when(token.isin(BOOSTERS), BOOST).when(token.isin(DAMPERS), -BOOST).otherwise(0.0)
        return F.struct(
            token.alias("token"),
            ((w == F.upper(w)) & (w != token)).alias("upper"),
            F.when((step != 0) & ~F.array_contains("valued", token), step).otherwise(0.0).alias("step"),
            F.replace(token, F.lit("'"), F.lit("")).isin(NEGATIONS).alias("negates"),
        )

    rows = _made(rows, "words", F.transform("words", mark)).drop("valued")
    mixed = F.exists("words", lambda m: m["upper"]) & F.exists("words", lambda m: ~m["upper"])
    but_at = F.array_position(F.transform("words", lambda m: m["token"]), "but") - 1  # -1 where there is none
    rows = rows.withColumn("mixed", mixed).withColumn("but_at", but_at)
    rows = _made(rows, "context", F.struct("mixed", "but_at")).drop("mixed", "but_at")

    def factor(m: Column, place: Column) -> Column:
        loud = F.col("context.mixed")
        added, times = F.when(m["upper"] & loud, CAPITALS).otherwise(0.0), F.lit(1.0)
        for k, damping in zip((1, 2, 3), DAMPING, strict=True):
            before = F.when(place >= k, F.get("words", place - k))
            step = before["step"] + F.when(before["upper"] & loud, F.signum(before["step"]) * CAPITALS).otherwise(0.0)
            added = added + F.coalesce(step * damping, F.lit(0.0))
            times = times * F.when(before["negates"], NEGATED).otherwise(1.0)
        at = F.col("context.but_at")
        side = F.when(at < 0, 1.0).when(place < at, BEFORE_BUT).when(place > at, AFTER_BUT).otherwise(1.0)
        return F.struct(m["token"].alias("token"), (times * side).alias("times"), added.alias("added"))

    return rows.select("id", F.explode(F.transform("words", factor)).alias("f")).select("id", "f.*")


def _adjusted(texts: DataFrame, lexicon: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, total)``: sums of valences after the rules on words."""
    acting = lexicon.where(F.col("token").isin([*BOOSTERS, *DAMPERS]) & F.col("valence").isNotNull())
    found = factors(texts, acting.agg(F.collect_set("token").alias("valued")), id_col, text_col)
    # Spark broadcasts the lexicon if it turns out small, and shuffles it otherwise.
    found = found.join(lexicon, "token")
    return found.where("valence is not null").groupBy("id").agg(F.sum((F.col("valence") + F.signum("valence") * F.col("added")) * F.col("times")).alias("total"))


def score(texts: DataFrame, lexicon: DataFrame, rules: bool = True, id_col: str = "id", text_col: str = "title") -> DataFrame:
    """``texts`` with ``sentiment_score`` and ``sentiment_label``.

    A null or empty text, or one without a word of the lexicon, has 0.0.
    With ``rules`` off, the score is that of the bare sum of valences. Ids
    must be unique; texts of one id would be summed.
    """
    require(texts, id_col, text_col)
    lexicon = lexicon.select(F.lower("token").alias("token"), F.col("valence").cast("double").alias("valence"))
    if rules:
        totals = _adjusted(texts, lexicon, id_col, text_col)
        marks = F.least(F.length(F.regexp_replace(text_col, "[^!]", "")), F.lit(EXCLAMATIONS)) * EXCLAMATION
        asked = F.length(F.regexp_replace(text_col, "[^?]", ""))
        marks = marks + F.when(asked > 3, QUESTIONS_MOST).when(asked > 1, asked * QUESTION).otherwise(0.0)
    else:
        # Spark broadcasts the lexicon if it turns out small, and shuffles it otherwise.
        found = words(texts, id_col, text_col).withColumn("token", F.lower("word")).join(lexicon, "token")
        totals, marks = found.where("valence is not null").groupBy("id").agg(F.sum("valence").alias("total")), F.lit(0.0)
    joined = texts.join(totals.select(F.col("id").alias("_id"), F.col("total").alias("_total")), F.col(id_col) == F.col("_id"), "left")
    emphasised = F.col("_total") + F.signum("_total") * marks
    out = joined.withColumn("sentiment_score", F.coalesce(compound(emphasised), F.lit(0.0))).drop("_id", "_total")
    return out.withColumn("sentiment_label", sentiment_label(F.col("sentiment_score")))


def spelled_scores(tokens: DataFrame) -> DataFrame:
    """``(id, sentiment_score)`` by the bare sum of the valences that ``derived_lexicon`` has for ``tokens(id, token)``
    in lower case; texts without a word have no row. That lexicon has every word, and a valence by its spelling, so
    words needn't be joined with it: sums of a text are made where it lies, and no word is shuffled."""
    totals = tokens.groupBy("id").agg(F.sum(spelled_valence(F.col("token"))).alias("total"))
    return totals.select("id", compound(F.col("total")).alias("sentiment_score"))


def with_scores(stories: DataFrame, scores: DataFrame) -> DataFrame:
    """``stories`` with the scores of ``spelled_scores``, 0.0 where there is none, and their labels."""
    out = stories.join(scores, "id", "left").withColumn("sentiment_score", F.coalesce("sentiment_score", F.lit(0.0)))
    return out.withColumn("sentiment_label", sentiment_label(F.col("sentiment_score")))
