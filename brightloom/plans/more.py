"""More of the engine's operators applied to the driver's tables and to its own reference tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brightloom.functions import signal as sg
from brightloom.functions import sound
from brightloom.functions import tags as tg
from brightloom.functions import text as tx
from brightloom.operators import corpus, domains, scoring
from brightloom.plans.queries import _intent_pairs, _joined, sequences, split_assign, table

#: Short signals: frames of 16 samples every 8, at 1 kHz.
SHORT = {"rate": 1000, "frame_ms": 16, "hop_ms": 8, "n_fft": 16, "n_mels": 4, "low": 20.0, "high": 480.0}


def domain_slots(spark, sf_dir):
    return domains.slot_table(spark).select("domain", "slot", F.col("position").cast("long").alias("position"), "value_type", F.coalesce(F.array_join("choices", "|"), F.lit("")).alias("choices"), "low", "high")


def domain_intents(spark, sf_dir):
    return domains.intent_table(spark).select("domain", "intent", F.array_join("slots", ",").alias("slots"), F.array_join("required", ",").alias("required"))


def template_tokens(spark, sf_dir):
    t = domains.template_table(spark)
    slots = F.filter("tokens", lambda x: F.startswith(x, F.lit("{")))
    return t.select("domain", "language", "pattern_id", "intent", F.size("tokens").cast("long").alias("n_tokens"), F.size(slots).cast("long").alias("n_slots"))


def lexicon_values(spark, sf_dir):
    """Every surface's value suits its slot."""
    return domains.values_checked(domains.lexicon_table(spark)).select("domain", "language", "slot", "surface", "value", "value_ok")


def value_check(spark, sf_dir):
    """Values made from parts against the slots of the domains; the last is of no slot of its domain."""
    genre = F.element_at(F.array(*[F.lit(g) for g in ("pop", "folk", "jazz", "rock")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    time = F.concat(F.lpad((F.col("p_size") % 30).cast("string"), 2, "0"), F.lit(":30"))
    cases = [
        ("music-control", "genre", genre), ("music-control", "volume-level", (F.col("p_size") * 3).cast("string")), ("music-control", "song", F.col("p_name")),
        ("calendar", "start-time", time), ("calendar", "participant", F.concat("p_type", "p_name")), ("weather", "song", F.col("p_name")),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(s).alias("slot"), v.alias("value")) for d, s, v in cases]))
    return domains.values_checked(table(spark, sf_dir, "part").select("p_partkey", each.alias("x")).select("p_partkey", "x.*"))


def annotation_check(spark, sf_dir):
    """A user's day as an annotation of the weather domain: x is a city, y a day, the first event the intent."""
    names = F.create_map(*[F.lit(v) for v in ("click", "query-weather", "view", "query-forecast", "signup", "weather-alert", "purchase", "set-volume", "error", "query-weather")])
    slots = F.transform(tg.promoted(F.col("gold")), lambda t: F.regexp_replace(F.regexp_replace(t, "-x$", "-city"), "-y$", "-day"))
    rows = sequences(spark, sf_dir).select("user_id", "day", F.lit("weather").alias("domain"), F.element_at(names, F.col("gold_intent")).alias("intent"), slots.alias("tags"))
    return domains.annotations_checked(rows).select("user_id", "day", "intent", F.coalesce("problem", F.lit("none")).alias("problem"))


def cjk_characters(spark, sf_dir):
    chars = domains.lexicon_table(spark).select(F.explode(F.split("surface", "")).alias("character")).where("character <> ''").distinct()
    return chars.select("character", tx.is_cjk(F.col("character")).alias("cjk"))


def confusion_totals(spark, sf_dir):
    return scoring.matrix_totals(scoring.confusion(_intent_pairs(spark, sf_dir))).select("total", "correct", F.round("accuracy", 9).alias("accuracy"))


def sample_text(spark, sf_dir):
    """The texts of a conversation in one: its length and hash."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    text = F.array_join(F.transform(F.filter("turns", lambda t: t["text"].isNotNull()), lambda t: t["text"]), "\n")
    return c.select("conv_id", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("sha256"))


def exact_groups(spark, sf_dir):
    g = corpus.exact_duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", tx.normalised(F.col("text")))
    return g.select("text_hash", "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def feature_vector(spark, sf_dir):
    """The dense vector of each turn, by its largest entry and its sum."""
    c = table(spark, sf_dir, "conversations").select(F.expr("conv_id * 1000 + turn").alias("id"), corpus.feature_vector(tx.normalised(F.col("text"))).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return c.select("id", F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("n_buckets"), F.round(F.array_max("v"), 9).alias("largest"), F.round(total, 9).alias("total"))


def spans_of_bioes(spark, sf_dir):
    """Spans of BIOES tags, by way of BIO."""
    s = sequences(spark, sf_dir).withColumn("t", tg.bioes_to_bio(tg.bio_to_bioes(tg.promoted(F.col("gold")))))
    return s.select("user_id", "day", F.explode(tg.spans(F.col("t"))).alias("s")).select("user_id", "day", "s.label", (F.col("s.end") - F.col("s.start")).cast("long").alias("n_tokens"), F.col("s.start").cast("long").alias("start_pos"))


def spans_to_bioes(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("s", tg.spans(tg.promoted(F.col("gold"))))
    return s.select("user_id", "day", _joined(tg.bio_to_bioes(tg.tags_of_spans(F.col("s"), F.size("gold")))).alias("tags"))


def tags_problem(spark, sf_dir):
    """Where a sequence breaks the rules first, -1 if nowhere."""
    return sequences(spark, sf_dir).select("user_id", "day", tg.first_invalid(F.col("gold")).cast("long").alias("first_bad"))


def split_values(spark, sf_dir):
    """The nations of each split's customers."""
    from brightloom.sources.store import per_split

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey").join(split_assign(spark, sf_dir), F.col("k") == F.col("c_custkey"))
    return per_split(c, "c_nationkey").select("split", F.col("value").cast("long").alias("value"))


def row_digest(spark, sf_dir):
    from brightloom.sources.store import row_digests

    return row_digests(table(spark, sf_dir, "nation"), "n_nationkey").select(F.col("key").cast("long").alias("key"), "digest")


def speaker_shifts(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", sound.speaker_shift(F.col("c_custkey")).alias("shift"))


def token_sounds(spark, sf_dir):
    """A nation's name as a plain token and as a city."""
    n = table(spark, sf_dir, "nation")
    hz = sound.value_hz(F.lit("weather"), F.lit("city"), F.col("n_name"))
    return n.select("n_nationkey", F.round(sound.filler_hz(F.lit("weather"), F.col("n_name")), 6).alias("filler"), F.round(hz[0], 6).alias("first"), F.round(hz[1], 6).alias("second"))


def generated_counts(spark, sf_dir):
    from brightloom.operators.generate import generated

    rows = generated(spark, "weather", "en", {"train": 64, "dev": 16, "test": 16}, seed=1234)
    return rows.groupBy("split", "pattern_id", F.col("speaker_id").cast("long").alias("speaker_id"), "snr_db").agg(F.count(F.lit(1)).alias("n"))


def generated_layout(spark, sf_dir):
    """Of each example what follows from its tokens: samples, segments, and the value of each slot among the surfaces."""
    from brightloom.operators.generate import generated

    rows = generated(spark, "calendar", "en", {"train": 30, "dev": 10}, seed=7, policy="pattern")
    tokens = F.size("tokens")
    good = (F.col("n_samples") == 320 + 1600 * tokens) & (F.size("segment_starts") == tokens) & (F.size("tags") == tokens) & tg.is_valid_sequence(F.col("tags"))
    return rows.select("utterance_id", good.alias("layout_ok"), F.col("intent").eqNullSafe(F.split("pattern_id", "/")[1]).alias("intent_ok"))


def pcm_back(spark, sf_dir):
    v = F.transform("embedding", lambda x: sg.from_pcm16(sg.to_pcm16(x)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(v).alias("pos", "sample")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("sample").cast("double"), 7).alias("sample"))


def frame_signal(spark, sf_dir):
    """Frames of 16 samples, every 8, by their ends."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(sg.frames(F.col("embedding"), 16, 8)).alias("frame", "x"))
    return e.select("vec_id", F.col("frame").cast("long").alias("frame"), F.round(F.col("x")[0].cast("double"), 7).alias("first"), F.round(F.element_at("x", -1).cast("double"), 7).alias("last"), F.size("x").cast("long").alias("n"))


def stft_power(spark, sf_dir):
    from brightloom.signal.columns import power_columns

    p = power_columns(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples")), SHORT)
    each = p.select("vec_id", F.posexplode("power").alias("frame", "bins")).select("vec_id", "frame", F.posexplode("bins").alias("bin", "power"))
    return each.select("vec_id", F.col("frame").cast("long").alias("frame"), F.col("bin").cast("long").alias("bin"), F.round("power", 6).alias("power"))


def mel_filterbank(spark, sf_dir):
    from brightloom.signal.kernels import mel_filterbank as bank

    w = bank(SHORT["rate"], SHORT["n_fft"], SHORT["n_mels"], SHORT["low"], SHORT["high"])
    return spark.createDataFrame([(m, b, round(float(x), 9)) for m, row in enumerate(w) for b, x in enumerate(row)], "mel long, bin long, weight double")


def fixture_misses(spark, sf_dir):
    """Requests that no fixture answers: documents looked up among the labels."""
    from brightloom.serve.protocol import replay

    fixtures = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("request_id"), F.col("quality").cast("string").alias("response"))
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("request_id"))
    return replay(asked, fixtures).groupBy("missing").agg(F.count(F.lit(1)).alias("n"))


NAMES = (
    "domain_slots domain_intents template_tokens lexicon_values value_check annotation_check cjk_characters confusion_totals sample_text exact_groups feature_vector "
    "spans_of_bioes spans_to_bioes tags_problem split_values row_digest speaker_shifts token_sounds generated_counts generated_layout pcm_back frame_signal "
    "stft_power mel_filterbank fixture_misses"
).split()


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}
