"""The engine's operators applied to the driver's tables, one query each.

Label sequences are the events of a user on a day in order of time; predicted
ones are the same with a fixed perturbation. Intents are label columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brightloom.functions import signal as sg
from brightloom.functions import tags as tg
from brightloom.functions import text as tx
from brightloom.operators import corpus, scoring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(a: Column) -> Column:
    return F.array_join(a, " ")


def _spans_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["label"], s["start"], s["end"])), ";")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, gold, pred, intent_gold, intent_pred): a row for each user and day, raw tags."""
    kind = F.col("event_type")
    tag = F.when(kind == "click", "O").when(kind == "view", "B-x").when(kind == "signup", "I-x").when(kind == "purchase", "B-y").otherwise("I-y")
    pred = F.when(F.col("event_id") % 7 == 0, "O").when(F.col("event_id") % 11 == 0, "B-x").otherwise(tag)
    ev = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.struct("ts", "event_id", tag.alias("g"), pred.alias("p"), kind.alias("k")).alias("e"))
    rows = ev.groupBy("user_id", "day").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return rows.select(
        "user_id", "day", F.col("e.g").alias("gold"), F.col("e.p").alias("pred"),
        F.element_at("e", 1)["k"].alias("gold_intent"),
        F.when(F.element_at("e", 1)["event_id"] % 5 == 0, "click").otherwise(F.element_at("e", 1)["k"]).alias("pred_intent"),
    )


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sequences(spark, sf_dir)
    return scoring.scored(s.withColumns({"gold_tags": tg.promoted(F.col("gold")), "pred_tags": tg.promoted(F.col("pred"))}))


def tags_repair_promote(spark, sf_dir):
    return sequences(spark, sf_dir).select("user_id", "day", _joined(tg.promoted(F.col("gold"))).alias("tags"))


def tags_repair_drop(spark, sf_dir):
    return sequences(spark, sf_dir).select("user_id", "day", _joined(tg.dropped(F.col("gold"))).alias("tags"))


def tags_valid(spark, sf_dir):
    return sequences(spark, sf_dir).select("user_id", "day", tg.is_valid_sequence(F.col("gold")).alias("valid"))


def tags_to_spans(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("t", tg.promoted(F.col("gold")))
    return s.select("user_id", "day", F.explode(tg.spans(F.col("t"))).alias("s")).select("user_id", "day", "s.label", F.col("s.start").cast("long").alias("start_pos"), F.col("s.end").cast("long").alias("end_pos"))


def spans_to_tags(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("s", tg.spans(tg.promoted(F.col("gold"))))
    return s.select("user_id", "day", _joined(tg.tags_of_spans(F.col("s"), F.size("gold"))).alias("tags"))


def bio_to_bioes(spark, sf_dir):
    return sequences(spark, sf_dir).select("user_id", "day", _joined(tg.bio_to_bioes(tg.promoted(F.col("gold")))).alias("tags"))


def bioes_to_bio(spark, sf_dir):
    return sequences(spark, sf_dir).select("user_id", "day", _joined(tg.bioes_to_bio(tg.bio_to_bioes(tg.promoted(F.col("gold"))))).alias("tags"))


def tag_slot_names(spark, sf_dir):
    names = F.array_sort(F.array_distinct(F.transform(F.filter("gold", lambda t: t != "O"), lambda t: F.substring(t, 3, 64))))
    return sequences(spark, sf_dir).select("user_id", "day", F.array_join(names, ",").alias("slots"))


def span_f1_strict(spark, sf_dir):
    m = scoring.micro(_records(spark, sf_dir), "strict")
    return m.select("gold", "pred", "credit", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def span_f1_partial(spark, sf_dir):
    m = scoring.micro(_records(spark, sf_dir), "partial")
    return m.select("gold", "pred", *[F.round(c, 9).alias(c) for c in ("credit", "precision", "recall", "f1")])


def intent_accuracy(spark, sf_dir):
    return scoring.accuracy(_records(spark, sf_dir), "intent_ok").withColumn("accuracy", F.round("accuracy", 9))


def turn_accuracy(spark, sf_dir):
    return scoring.accuracy(_records(spark, sf_dir), "turn_ok").withColumn("accuracy", F.round("accuracy", 9))


def slice_summary(spark, sf_dir):
    weekday = F.date_format("day", "yyyy-MM-dd")
    r = _records(spark, sf_dir).withColumn("slices", F.create_map(F.lit("day"), weekday, F.lit("user"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"))))
    return scoring.slice_summary(r).select("kind", "value", "records", F.round("intent_accuracy", 9).alias("intent_accuracy"), F.round("slot_strict", 9).alias("slot_strict"))


def _intent_pairs(spark, sf_dir):
    k, i = F.col("event_type"), F.col("event_id")
    pred = F.when(i % 5 == 0, "click").when(i % 13 == 0, "error").otherwise(k)
    return table(spark, sf_dir, "events").select(k.alias("gold"), pred.alias("pred"))


def confusion(spark, sf_dir):
    return scoring.confusion(_intent_pairs(spark, sf_dir))


def confusion_per_label(spark, sf_dir):
    return scoring.per_label(scoring.confusion(_intent_pairs(spark, sf_dir))).select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


def bootstrap_ci(spark, sf_dir):
    r = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == F.col("toxic")).cast("int").alias("ok"))
    ci = scoring.bootstrap_scalable(r, "ok", F.lit(1), "doc_id", replicates=200)
    return ci.select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "replicates")


def percentile(spark, sf_dir):
    ends = F.percentile("l_extendedprice", F.array(F.lit(0.025), F.lit(0.975)))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(ends.alias("e")).select("l_returnflag", F.round(F.col("e")[0], 6).alias("low"), F.round(F.col("e")[1], 6).alias("high"))


def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalised(F.col("text")).alias("normalized"))


def normalize_text_full(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalised_full(F.col("text")).alias("normalized"))


def text_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.text_hash(tx.normalised(F.col("text"))).alias("text_hash"))


def exact_duplicate_groups(spark, sf_dir):
    return corpus.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", tx.normalised(F.col("text"))).select(F.col("id").alias("doc_id"), "text_hash", "first_id", "n")


def gram_vector(spark, sf_dir):
    return corpus.gram_vectors(table(spark, sf_dir, "conversations").select(F.expr("conv_id * 1000 + turn").alias("id"), "text"), "id", tx.normalised(F.col("text")))


def near_duplicate_pairs(spark, sf_dir):
    return corpus.near_duplicate_pairs(table(spark, sf_dir, "embeddings"), 0.4, "vec_id", "embedding").select("a", "b", F.round("cosine", 6).alias("cosine"))


def turn_structure(spark, sf_dir):
    return corpus.turn_structure(table(spark, sf_dir, "conversations"))


def quality_flags(spark, sf_dir):
    """Durations and SNR stand in for audio references: text length and the turn's number."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    snr = F.when(F.col("turn") % 3 == 0, F.lit(None)).otherwise(F.col("turn") * 5.0)
    flags = corpus.quality_columns(F.length("text") * 10.0, snr, F.col("text"), F.lit("The"), min_snr=10.0)
    return c.withColumns(flags).select("conv_id", "turn", "duration_ok", "snr_ok", "answer_canonical", F.array_join("issues", ",").alias("issues"))


def quality_report(spark, sf_dir):
    flags = quality_flags(spark, sf_dir).select(F.explode(F.split(F.when(F.col("issues") == "", "ok").otherwise(F.col("issues")), ",")).alias("issue"))
    return corpus.count_by(flags, "issue")


def template_render(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.render(corpus.ANSWERS["en"], {"intent": F.col("p_brand"), "slots": F.col("p_type")}).alias("answer"))


def template_variables(spark, sf_dir):
    t = F.concat(F.lit("{intent} of {brand}: "), F.col("p_name"), F.lit(" {intent}"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.template_variables(t), ",").alias("variables"))


def slots_text(spark, sf_dir):
    m = F.create_map(F.lit("region"), F.array(F.col("r_name")), F.lit("nation"), F.array(F.col("n_name"), F.lower("n_name")))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", tx.slots_text(m, ["nation", "city", "region"]).alias("slots"))


def tokenize_en(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", tx.tokenize(F.col("text"), "en").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", "\n"), 256).alias("tokens_sha256"))


def tokenize_chars(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.tokenize(F.col("text"), "zh").alias("t"))
    return t.select("conv_id", "turn", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", "\n"), 256).alias("tokens_sha256"))


def mixing_quotas(spark, sf_dir):
    w = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return corpus.mixing_quota_table(w, 137)


def mix_samples(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("source"), F.col("c_custkey").alias("sample_id"))
    names = sorted(r["source"] for r in d.select("source").distinct().collect())
    return corpus.mix_samples(d, {n: float(k + 1) for k, n in enumerate(names)}, 60, 7).select("source", "sample_id", F.col("position").cast("long").alias("position"))


def split_assign(spark, sf_dir):
    return corpus.assign_splits(table(spark, sf_dir, "customer"), "c_custkey", {"train": 8, "dev": 1, "test": 1}, 7)


def derive_seed(spark, sf_dir):
    payload = F.concat(F.lit('["example",7,"train",'), F.col("o_orderkey").cast("string"), F.lit("]"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.derived_seed(payload).alias("seed"))


def leakage_check(spark, sf_dir):
    """Orders follow their customer's split; a customer in more than one split would leak."""
    keys = split_assign(spark, sf_dir)
    o = table(spark, sf_dir, "orders").join(keys, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("split").agg(F.count(F.lit(1)).alias("n_orders"), F.countDistinct("o_custkey").alias("n_customers"))


def dataset_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"),
        F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
    )


def slot_mentions(spark, sf_dir):
    s = sequences(spark, sf_dir).select(F.explode(tg.promoted(F.col("gold"))).alias("t")).where(F.startswith("t", F.lit("B-")))
    return s.groupBy(F.substring("t", 3, 64).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def count_by(spark, sf_dir):
    return corpus.count_by(table(spark, sf_dir, "documents"), "lang")


def _segments(spark, sf_dir):
    """Lines of an order as segments, laid end to end with a gap of 320 samples; length by quantity."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    n = (F.col("l_quantity") * 20).cast("long")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", n.alias("n"))
    return li.withColumns({"idx": F.row_number().over(w) - 1, "end": F.sum(F.col("n") + 320).over(w)}).withColumn("start", F.col("end") - F.col("n"))


def _frames(spark, sf_dir):
    seg = _segments(spark, sf_dir)
    total = seg.groupBy("l_orderkey").agg((F.max("end") + 320).alias("total"))
    n = sg.frame_count(F.col("total"), 400, 160)
    fr = total.select("l_orderkey", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))).alias("frame")).withColumn("center", F.col("frame") * 160 + 200)
    on = (F.col("l_orderkey") == F.col("k")) & (F.col("center") >= F.col("start")) & (F.col("center") < F.col("end"))
    hit = fr.join(seg.select(F.col("l_orderkey").alias("k"), "idx", "start", "end"), on, "left")
    return hit.select("l_orderkey", "frame", F.coalesce("idx", F.lit(-1)).cast("long").alias("token"))


def frame_token_map(spark, sf_dir):
    return _frames(spark, sf_dir).groupBy("l_orderkey", "token").agg(F.count(F.lit(1)).alias("n_frames"), F.min("frame").alias("first"), F.max("frame").alias("last"))


def frame_span_tags(spark, sf_dir):
    tag = F.when(F.col("idx") % 3 == 0, "B-item").when(F.col("idx") % 3 == 1, "I-item").otherwise("O")
    tokens = _segments(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("idx", tag.alias("t")))).alias("t"))
    frames = _frames(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("frame", "token"))).alias("f"))
    both = tokens.join(frames, "l_orderkey")
    return both.select("l_orderkey", F.explode(tg.spans(tg.frame_span_tags(F.col("t.t"), F.col("f.token")))).alias("s")).select("l_orderkey", F.col("s.start").cast("long").alias("first"), (F.col("s.end") - 1).cast("long").alias("last"))


def frame_count(spark, sf_dir):
    n = (F.col("o_totalprice") / 10).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", sg.frame_count(n, 400, 160).alias("n_frames"))


def window_values(spark, sf_dir):
    rows = spark.range(400).select(F.col("id").alias("n"))
    names = [F.struct(F.lit(k).alias("name"), F.round(sg.window_value(k, F.col("n"), 400), 9).alias("value")) for k in sg.WINDOWS]
    return rows.select("n", F.explode(F.array(*names)).alias("x")).select("n", "x.name", "x.value")


def mel_scale(spark, sf_dir):
    hz = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(sg.hz_to_mel(hz), 6).alias("mel"), F.round(sg.mel_to_hz(sg.hz_to_mel(hz)), 6).alias("hz"))


def pcm_roundtrip(spark, sf_dir):
    v = F.transform("embedding", lambda x: sg.to_pcm16(x))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(v).alias("pos", "pcm")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("pcm").cast("long").alias("pcm"))


def cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    first = e.select("label", "vec_id", "embedding").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    return e.join(F.broadcast(first), "label").select("vec_id", F.round(tx.cosine(F.col("embedding"), F.col("head")), 6).alias("cosine"))


def json_validate(spark, sf_dir):
    props = F.col("props")
    keys = F.json_object_keys(props)
    return table(spark, sf_dir, "events").select("event_id", keys.isNotNull().alias("is_object"), F.coalesce(F.size(keys), F.lit(0)).cast("long").alias("n_keys"), F.array_join(F.array_sort(keys), ",").alias("key_names"))


def check_value(spark, sf_dir):
    """Slot values by type: enum, number in bounds, text by length."""
    from brightloom.operators.schema import value_ok

    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        value_ok(F.col("p_brand"), "enum", choices=["Brand#11", "Brand#12", "Brand#23"]).alias("brand_ok"),
        value_ok(F.col("p_retailprice"), "number", minimum=950.0, maximum=1500.0).alias("price_ok"),
        value_ok(F.col("p_name"), "text", min_length=1, max_length=12).alias("name_ok"),
        value_ok(F.concat(F.lpad((F.col("p_size") % 30).cast("string"), 2, "0"), F.lit(":30")), "time").alias("time_ok"),
    )


def validate_ids(spark, sf_dir):
    from brightloom.operators.schema import valid_id

    name = F.lower(F.replace("p_type", F.lit(" "), F.lit("-")))
    return table(spark, sf_dir, "part").select("p_partkey", valid_id(name).alias("ok"), valid_id(F.col("p_type")).alias("raw_ok"))


def fixture_lookup(spark, sf_dir):
    """Requests (orders) answered from fixtures (customers)."""
    from brightloom.serve.protocol import replay

    fixtures = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_mktsegment").alias("response"))
    answered = replay(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("request_id")), fixtures)
    return answered.select("o_orderkey", F.coalesce("response", F.lit("missing")).alias("response"))


def dataset_split_counts(spark, sf_dir):
    """Counts for each split, zeros included."""
    every = spark.createDataFrame([(s,) for s in ("train", "dev", "test", "none")], "split string")
    return every.join(split_assign(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))


def stream_frames(spark, sf_dir):
    """Frames committed as chunks of audio arrive: each event pushes samples by its value."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.sum((F.abs("value") * 100).cast("long") + 160).over(w).alias("pushed"))
    return ev.select("event_id", "pushed", sg.stream_frames(F.col("pushed"), 400, 160, 5120).alias("committed"))


def stream_intent(spark, sf_dir):
    """Running share of purchases as posterior; stable from 0.2 on; revisions count changes between stable intents."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, sf_dir, "events").withColumns(
        {"n": F.count(F.lit(1)).over(w), "buy": F.sum((F.col("event_type") == "purchase").cast("int")).over(w), "see": F.sum((F.col("event_type") == "view").cast("int")).over(w)}
    )
    best = F.greatest("buy", "see")
    ev = ev.withColumns({"intent": F.when(F.col("buy") >= F.col("see"), "purchase").otherwise("view"), "stable": best * 5 >= F.col("n")})
    held = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("stable"), F.col("intent")), ignorenulls=True).over(held)
    ev = ev.withColumn("change", F.coalesce(F.col("stable") & (last != F.col("intent")), F.lit(False)).cast("int"))
    return ev.groupBy("user_id").agg(F.sum("change").alias("revisions"), F.sum(F.col("stable").cast("int")).alias("n_stable"), F.min(F.when(F.col("stable"), F.col("n"))).alias("first_stable"))


def log_mel(spark, sf_dir):
    from brightloom.signal.columns import log_mel_summary

    return log_mel_summary(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples")))


def generate_dataset(spark, sf_dir):
    from brightloom.operators.generate import generated

    return generated(spark, "weather", "en", {"train": 64, "dev": 16, "test": 16}, seed=1234).drop("samples")


def stream_session(spark, sf_dir):
    from brightloom.streaming.session import run_sessions

    return run_sessions(spark, table(spark, sf_dir, "events"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to label sequences, repaired, to spans, counted by label."""
    return tags_to_spans(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("n_tokens"))


NAMES = (
    "tags_repair_promote tags_repair_drop tags_valid tags_to_spans spans_to_tags bio_to_bioes bioes_to_bio tag_slot_names span_f1_strict span_f1_partial "
    "intent_accuracy turn_accuracy slice_summary confusion confusion_per_label bootstrap_ci percentile normalize_text normalize_text_full text_hash "
    "exact_duplicate_groups gram_vector near_duplicate_pairs turn_structure quality_flags quality_report template_render template_variables slots_text "
    "tokenize_en tokenize_chars mixing_quotas mix_samples split_assign derive_seed leakage_check dataset_stats slot_mentions count_by frame_token_map "
    "frame_span_tags frame_count window_values mel_scale pcm_roundtrip cosine json_validate check_value validate_ids fixture_lookup dataset_split_counts "
    "stream_frames stream_intent log_mel generate_dataset stream_session flagship"
).split()


def queries() -> dict:
    from brightloom.plans import more

    return {n: globals()[n] for n in NAMES} | more.queries()
