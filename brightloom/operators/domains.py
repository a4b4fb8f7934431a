"""Task domains, lexicons and phrase templates as reference tables, and checks of annotations against them."""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.core.canonical import exact_keys, stable_hash, validate_id
from brightloom.core.errors import SchemaError, ValidationError

LANGUAGES = ("zh", "en")

# Domains. A slot has a name, a type, its constraint and a description; an intent its slots (name, optional) and a description.
DOMAINS: dict[str, dict[str, Any]] = {
    "calendar": {
        "description": "日程管理域",
        "slots": [
            {"name": "event-title", "value_type": "text", "constraint": {"min_length": 1, "max_length": 64}, "description": "事件标题"},
            {"name": "start-time", "value_type": "time", "constraint": {}, "description": "开始时间"},
            {"name": "end-time", "value_type": "time", "constraint": {}, "description": "结束时间"},
            {"name": "day", "value_type": "enum", "constraint": {"choices": ["今天", "明天", "后天", "周末"]}, "description": "日期"},
            {"name": "participant", "value_type": "text", "constraint": {"min_length": 1, "max_length": 32}, "description": "参与人"},
        ],
        "intents": [
            {"name": "create-event", "slots": [("event-title", False), ("start-time", False), ("end-time", True), ("participant", True)], "description": "创建日程"},
            {"name": "list-events", "slots": [("day", True)], "description": "查询日程"},
            {"name": "cancel-event", "slots": [("event-title", False)], "description": "取消日程"},
            {"name": "set-reminder", "slots": [("event-title", False), ("start-time", False), ("day", True)], "description": "设置提醒"},
        ],
    },
    "music-control": {
        "description": "音乐控制域",
        "slots": [
            {"name": "song", "value_type": "text", "constraint": {"min_length": 1, "max_length": 64}, "description": "歌名"},
            {"name": "artist", "value_type": "text", "constraint": {"min_length": 1, "max_length": 64}, "description": "歌手"},
            {"name": "genre", "value_type": "enum", "constraint": {"choices": ["pop", "rock", "jazz", "classical", "electronic"]}, "description": "流派"},
            {"name": "volume-level", "value_type": "number", "constraint": {"minimum": 0.0, "maximum": 100.0}, "description": "音量"},
            {"name": "playlist", "value_type": "text", "constraint": {"min_length": 1, "max_length": 64}, "description": "歌单"},
        ],
        "intents": [
            {"name": "play-music", "slots": [("song", True), ("artist", True), ("genre", True), ("playlist", True)], "description": "播放音乐"},
            {"name": "pause-music", "slots": [], "description": "暂停"},
            {"name": "resume-music", "slots": [], "description": "继续播放"},
            {"name": "stop-music", "slots": [], "description": "停止"},
            {"name": "next-track", "slots": [], "description": "下一首"},
            {"name": "previous-track", "slots": [], "description": "上一首"},
            {"name": "set-volume", "slots": [("volume-level", False)], "description": "设置音量"},
        ],
    },
    "navigation": {
        "description": "导航出行域",
        "slots": [
            {"name": "destination", "value_type": "text", "constraint": {"min_length": 1, "max_length": 64}, "description": "目的地"},
            {"name": "origin", "value_type": "text", "constraint": {"min_length": 1, "max_length": 64}, "description": "出发地"},
            {"name": "transport", "value_type": "enum", "constraint": {"choices": ["walk", "drive", "transit", "bike"]}, "description": "出行方式"},
            {"name": "category", "value_type": "enum", "constraint": {"choices": ["food", "fuel", "parking", "hotel"]}, "description": "地点类别"},
        ],
        "intents": [
            {"name": "navigate-to", "slots": [("destination", False), ("origin", True), ("transport", True)], "description": "导航"},
            {"name": "find-route", "slots": [("origin", False), ("destination", False), ("transport", True)], "description": "查路线"},
            {"name": "search-nearby", "slots": [("category", False)], "description": "附近搜索"},
        ],
    },
    "weather": {
        "description": "天气查询域",
        "slots": [
            {"name": "city", "value_type": "enum", "constraint": {"choices": ["北京", "上海", "广州", "深圳", "杭州"]}, "description": "城市"},
            {"name": "day", "value_type": "enum", "constraint": {"choices": ["今天", "明天", "后天", "周末"]}, "description": "日期"},
            {"name": "clock", "value_type": "time", "constraint": {}, "description": "时间点 HH:MM"},
            {"name": "metric", "value_type": "enum", "constraint": {"choices": ["temperature", "rain", "wind", "humidity"]}, "description": "指标"},
        ],
        "intents": [
            {"name": "query-weather", "slots": [("city", False), ("day", True), ("metric", True)], "description": "查询天气"},
            {"name": "query-forecast", "slots": [("city", True), ("day", False), ("clock", True)], "description": "查询预报"},
            {"name": "weather-alert", "slots": [("city", True)], "description": "天气预警"},
        ],
    },
}

# For each slot the surfaces, and the value each stands for.
LEXICONS: dict[tuple[str, str], dict[str, dict[str, Any]]] = {
    ("weather", "zh"): {
        "city": {"北京": "北京", "上海": "上海", "广州": "广州"},
        "day": {"今天": "今天", "明天": "明天", "周末": "周末"},
        "clock": {"七点半": "07:30", "九点": "09:00"},
        "metric": {"气温": "temperature", "下雨": "rain", "风力": "wind"},
    },
    ("music-control", "zh"): {
        "song": {"青花瓷": "青花瓷", "稻香": "稻香", "夜曲": "夜曲"},
        "artist": {"周杰伦": "周杰伦", "邓紫棋": "邓紫棋"},
        "genre": {"流行": "pop", "摇滚": "rock", "爵士": "jazz"},
        "volume-level": {"三十": 30, "五十": 50, "八十": 80},
        "playlist": {"我的收藏": "我的收藏", "跑步歌单": "跑步歌单"},
    },
    ("navigation", "zh"): {
        "destination": {"人民广场": "人民广场", "虹桥机场": "虹桥机场", "公司": "公司"},
        "origin": {"家": "家", "学校": "学校"},
        "transport": {"步行": "walk", "开车": "drive", "地铁": "transit"},
        "category": {"餐厅": "food", "加油站": "fuel", "停车场": "parking"},
    },
    ("calendar", "zh"): {
        "event-title": {"开会": "开会", "体检": "体检", "面试": "面试"},
        "start-time": {"九点": "09:00", "十四点半": "14:30"},
        "end-time": {"十点": "10:00", "十六点": "16:00"},
        "day": {"今天": "今天", "明天": "明天", "周末": "周末"},
        "participant": {"张伟": "张伟", "李娜": "李娜"},
    },
    ("weather", "en"): {
        "city": {"Beijing": "北京", "Shanghai": "上海"},
        "day": {"today": "今天", "tomorrow": "明天"},
        "clock": {"seven thirty": "07:30", "nine": "09:00"},
        "metric": {"temperature": "temperature", "rain": "rain"},
    },
    ("music-control", "en"): {
        "song": {"Blue Porcelain": "青花瓷", "Rice Fields": "稻香"},
        "artist": {"Zhou Jielun": "周杰伦", "Deng Ziqi": "邓紫棋"},
        "genre": {"pop": "pop", "rock": "rock"},
        "volume-level": {"thirty": 30, "fifty": 50},
        "playlist": {"my favorites": "我的收藏", "running mix": "跑步歌单"},
    },
    ("navigation", "en"): {
        "destination": {"People's Square": "人民广场", "Hongqiao Airport": "虹桥机场"},
        "origin": {"home": "家", "school": "学校"},
        "transport": {"by car": "drive", "on foot": "walk"},
        "category": {"restaurants": "food", "parking": "parking"},
    },
    ("calendar", "en"): {
        "event-title": {"standup meeting": "开会", "checkup": "体检"},
        "start-time": {"nine": "09:00", "two thirty": "14:30"},
        "end-time": {"ten": "10:00", "four": "16:00"},
        "day": {"today": "今天", "tomorrow": "明天"},
        "participant": {"Zhang Wei": "张伟", "Li Na": "李娜"},
    },
}

# Phrase templates, domain/intent/number and tokens; a slot is in braces.
TEMPLATES: dict[tuple[str, str], list[tuple[str, str]]] = {
    ("weather", "zh"): [
        ("weather/query-weather/0", "{city} {day} 天 气 怎 么 样"),
        ("weather/query-weather/1", "帮 我 查 {city} 天 气"),
        ("weather/query-forecast/0", "{day} {city} 天 气 预 报"),
        ("weather/query-forecast/1", "{day} 会 下 雨 吗"),
        ("weather/weather-alert/0", "有 天 气 预 警 吗"),
        ("weather/weather-alert/1", "{city} 有 预 警 吗"),
    ],
    ("music-control", "zh"): [
        ("music-control/play-music/0", "播 放 {song}"),
        ("music-control/play-music/1", "来 一 首 {genre} 音 乐"),
        ("music-control/play-music/2", "播 放 {playlist}"),
        ("music-control/pause-music/0", "暂 停 播 放"),
        ("music-control/resume-music/0", "继 续 播 放"),
        ("music-control/stop-music/0", "停 止 播 放"),
        ("music-control/next-track/0", "下 一 首"),
        ("music-control/previous-track/0", "上 一 首"),
        ("music-control/set-volume/0", "音 量 调 到 {volume-level}"),
    ],
    ("navigation", "zh"): [
        ("navigation/navigate-to/0", "导 航 到 {destination}"),
        ("navigation/navigate-to/1", "{transport} 去 {destination}"),
        ("navigation/find-route/0", "从 {origin} 到 {destination} 怎 么 走"),
        ("navigation/search-nearby/0", "附 近 的 {category}"),
    ],
    ("calendar", "zh"): [
        ("calendar/create-event/0", "创 建 {event-title} 的 {start-time} 日 程"),
        ("calendar/create-event/1", "{start-time} 开 {event-title}"),
        ("calendar/list-events/0", "查 一 下 {day} 的 安 排"),
        ("calendar/list-events/1", "我 有 哪 些 日 程"),
        ("calendar/cancel-event/0", "取 消 {event-title}"),
        ("calendar/set-reminder/0", "提 醒 我 {start-time} {event-title}"),
    ],
    ("weather", "en"): [
        ("weather/query-weather/0", "what is the weather in {city}"),
        ("weather/query-weather/1", "is it raining in {city}"),
        ("weather/query-forecast/0", "{day} forecast for {city}"),
        ("weather/weather-alert/0", "any weather alerts"),
    ],
    ("music-control", "en"): [
        ("music-control/play-music/0", "play {song}"),
        ("music-control/pause-music/0", "pause the music"),
        ("music-control/resume-music/0", "resume the music"),
        ("music-control/stop-music/0", "stop playing"),
        ("music-control/next-track/0", "next track"),
        ("music-control/previous-track/0", "previous track"),
        ("music-control/set-volume/0", "set volume to {volume-level}"),
    ],
    ("navigation", "en"): [
        ("navigation/navigate-to/0", "navigate to {destination}"),
        ("navigation/find-route/0", "route from {origin} to {destination}"),
        ("navigation/search-nearby/0", "find {category} nearby"),
    ],
    ("calendar", "en"): [
        ("calendar/create-event/0", "create event {event-title} at {start-time}"),
        ("calendar/list-events/0", "list my events"),
        ("calendar/cancel-event/0", "cancel {event-title}"),
        ("calendar/set-reminder/0", "remind me at {start-time} about {event-title}"),
    ],
}

#: Constraint keys by slot type.
CONSTRAINTS = {"enum": {"choices"}, "number": {"minimum", "maximum", "unit"}, "time": set(), "text": {"min_length", "max_length"}}
_TIME = re.compile(r"(?:[01][0-9]|2[0-3]):[0-5][0-9]")


def domain(name: str) -> dict[str, Any]:
    if name not in DOMAINS:
        raise ValidationError(f"unknown domain {name!r}; there are {sorted(DOMAINS)}")
    return DOMAINS[name]


def slot(domain_name: str, name: str) -> dict[str, Any]:
    found = [s for s in domain(domain_name)["slots"] if s["name"] == name]
    if not found:
        raise ValidationError(f"domain {domain_name!r} has no slot {name!r}")
    return found[0]


def intent(domain_name: str, name: str) -> dict[str, Any]:
    found = [i for i in domain(domain_name)["intents"] if i["name"] == name]
    if not found:
        raise ValidationError(f"domain {domain_name!r} has no intent {name!r}")
    return found[0]


def required_slots(an_intent: dict[str, Any]) -> list[str]:
    return [s for s, optional in an_intent["slots"] if not optional]


def domain_payload(name: str) -> dict[str, Any]:
    """A domain as canonical JSON values; what its hash covers."""
    d = domain(name)
    intents = [{"name": i["name"], "slots": [{"slot": s, "optional": o} for s, o in i["slots"]], "description": i["description"]} for i in d["intents"]]
    return {"schema": "brightloom.domain", "schema_version": 1, "domain": name, "description": d["description"], "slots": d["slots"], "intents": intents}


def domain_hash(name: str) -> str:
    return stable_hash(domain_payload(name))


def check_domain(payload: Any) -> dict[str, Any]:
    """A domain read from JSON, with every rule of names, types and references checked."""
    value = exact_keys(payload, {"schema", "schema_version", "domain", "description", "slots", "intents"}, "domain")
    if value["schema"] != "brightloom.domain" or value["schema_version"] is True or value["schema_version"] != 1:
        raise SchemaError("unknown domain schema or version")
    validate_id(value["domain"], "domain")
    names: list[str] = []
    for s in value["slots"]:
        exact_keys(s, {"name", "value_type", "constraint", "description"}, "slot")
        names.append(validate_id(s["name"], "slot"))
        if s["value_type"] not in CONSTRAINTS or set(s["constraint"]) - CONSTRAINTS[s["value_type"]]:
            raise SchemaError(f"slot {s['name']!r}: unknown type or constraint")
        choices = s["constraint"].get("choices", [])
        if s["value_type"] == "enum" and (not choices or len(set(choices)) != len(choices) or not all(isinstance(c, str) and c for c in choices)):
            raise SchemaError(f"slot {s['name']!r}: choices must be distinct and not empty")
        low, high = s["constraint"].get("minimum", s["constraint"].get("min_length")), s["constraint"].get("maximum", s["constraint"].get("max_length"))
        if low is not None and high is not None and low > high:
            raise SchemaError(f"slot {s['name']!r}: bounds out of order")
    intents = [exact_keys(i, {"name", "slots", "description"}, "intent") for i in value["intents"]]
    for what, all_names in (("slot", names), ("intent", [validate_id(i["name"], "intent") for i in intents])):
        if len(set(all_names)) != len(all_names):
            raise SchemaError(f"a {what} is there twice")
    if not intents:
        raise SchemaError("a domain needs an intent")
    for i in intents:
        if unknown := {exact_keys(s, {"slot", "optional"}, "slot reference")["slot"] for s in i["slots"]} - set(names):
            raise SchemaError(f"intent {i['name']!r} names unknown slots {sorted(unknown)}")
    return value


def value_problem(a_slot: dict[str, Any], value: Any) -> str | None:
    """Why a value doesn't suit a slot; null where it does."""
    kind, c = a_slot["value_type"], a_slot["constraint"]
    if kind == "number":
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
            return "not a finite number"
        return "out of bounds" if value < c.get("minimum", -math.inf) or value > c.get("maximum", math.inf) else None
    if not isinstance(value, str):
        return "not a string"
    if kind == "enum":
        return None if value in c["choices"] else "not a choice"
    if kind == "time":
        return None if _TIME.fullmatch(value) else "not a time HH:MM"
    return None if c.get("min_length", 1) <= len(value) <= c.get("max_length", 512) else "length out of bounds"


def lexicon_problems(domain_name: str, lexicon: dict[str, dict[str, Any]]) -> list[str]:
    """Unknown slots, empty slots, surfaces with white space at an end, and values that don't suit their slot."""
    known, out = {s["name"]: s for s in domain(domain_name)["slots"]}, []
    for name, entries in lexicon.items():
        if name not in known:
            out.append(f"unknown slot {name!r}")
        elif not entries:
            out.append(f"slot {name!r} has no entries")
        else:
            out += [f"{name!r}: surface {s!r}" for s in entries if not s or s != s.strip()]
            out += [f"{name!r}: {s!r} stands for {v!r}: {p}" for s, v in entries.items() if (p := value_problem(known[name], v))]
    return out


def template_problems(domain_name: str, templates: list[tuple[str, str]]) -> list[str]:
    """Badly formed or repeated ids, unknown intents, undeclared, missing or touching slots."""
    out, seen = [], set()
    for pattern, words in templates:
        parts, tokens = pattern.split("/"), words.split()
        if len(parts) != 3 or not parts[2].isdigit() or parts[0] != domain_name or pattern in seen or not tokens:
            out.append(f"{pattern}: bad or repeated id, or no tokens")
            continue
        seen.add(pattern)
        found = [i for i in domain(domain_name)["intents"] if i["name"] == parts[1]]
        if not found:
            out.append(f"{pattern}: unknown intent")
            continue
        used = [t[1:-1] for t in tokens if t[0] == "{" and t[-1] == "}"]
        if undeclared := set(used) - {s for s, _ in found[0]["slots"]}:
            out.append(f"{pattern}: undeclared slots {sorted(undeclared)}")
        if missing := set(required_slots(found[0])) - set(used):
            out.append(f"{pattern}: missing slots {sorted(missing)}")
        out += [f"{pattern}: {a} twice in a row" for a, b in zip(tokens, tokens[1:], strict=False) if a == b and a[0] == "{"]
    return out


def _new(domain_name: str, language: str, there: dict, problems: list[str]) -> None:
    domain(domain_name)
    if language not in LANGUAGES:
        raise ValidationError(f"language must be one of {LANGUAGES}: {language!r}")
    if (domain_name, language) in there:
        raise ValidationError(f"already there: {domain_name}/{language}")
    if problems:
        raise ValidationError("; ".join(problems))


def register_lexicon(domain_name: str, language: str, lexicon: dict[str, dict[str, Any]]) -> None:
    _new(domain_name, language, LEXICONS, lexicon_problems(domain_name, lexicon) or ([] if lexicon else ["empty lexicon"]))
    LEXICONS[domain_name, language] = lexicon


def register_templates(domain_name: str, language: str, templates: list[tuple[str, str]]) -> None:
    _new(domain_name, language, TEMPLATES, template_problems(domain_name, templates) or ([] if templates else ["no templates"]))
    TEMPLATES[domain_name, language] = templates


def registered(tables: dict) -> list[tuple[str, str]]:
    """The (domain, language) keys of ``LEXICONS`` or ``TEMPLATES``, sorted."""
    return sorted(tables)


def slot_entries(domain_name: str, language: str, name: str) -> dict[str, Any]:
    try:
        return LEXICONS[domain_name, language][name]
    except KeyError:
        raise ValidationError(f"no entries for {domain_name}/{language}/{name}") from None


def templates_for(domain_name: str, language: str) -> list[tuple[str, str]]:
    if (domain_name, language) not in TEMPLATES:
        raise ValidationError(f"no templates for {domain_name}/{language}")
    return TEMPLATES[domain_name, language]


# Reference tables


def slot_table(spark: SparkSession) -> DataFrame:
    """One row per slot: domain, slot, position, value_type, choices, low, high (bounds of a number or a length), description."""
    rows = []
    for d, spec in sorted(DOMAINS.items()):
        for i, s in enumerate(spec["slots"]):
            c = s["constraint"]
            low, high = c.get("minimum", c.get("min_length")), c.get("maximum", c.get("max_length"))
            rows.append((d, s["name"], i, s["value_type"], c.get("choices"), None if low is None else float(low), None if high is None else float(high), s["description"]))
    return spark.createDataFrame(rows, "domain string, slot string, position int, value_type string, choices array<string>, low double, high double, description string")


def intent_table(spark: SparkSession) -> DataFrame:
    """One row per intent: domain, intent, slots and required in order, description."""
    rows = [(d, i["name"], [s for s, _ in i["slots"]], required_slots(i), i["description"]) for d, spec in sorted(DOMAINS.items()) for i in spec["intents"]]
    return spark.createDataFrame(rows, "domain string, intent string, slots array<string>, required array<string>, description string")


def lexicon_table(spark: SparkSession) -> DataFrame:
    """One row per surface: domain, language, slot, surface, value (as text)."""
    rows = [(d, g, s, surface, str(v)) for (d, g), lexicon in sorted(LEXICONS.items()) for s, entries in lexicon.items() for surface, v in entries.items()]
    return spark.createDataFrame(rows, "domain string, language string, slot string, surface string, value string")


def template_table(spark: SparkSession) -> DataFrame:
    """One row per template: domain, language, pattern_id, intent, position, tokens."""
    rows = [(d, g, p, p.split("/")[1], i, words.split()) for (d, g), items in sorted(TEMPLATES.items()) for i, (p, words) in enumerate(items)]
    return spark.createDataFrame(rows, "domain string, language string, pattern_id string, intent string, position int, tokens array<string>")


def values_checked(rows: DataFrame) -> DataFrame:
    """``rows`` (domain, slot, value as text) with ``value_ok``: false for unknown slots and null values too.

    The slot table is a fixed one and broadcast.
    """
    s = F.broadcast(slot_table(rows.sparkSession).select(F.col("domain").alias("_d"), F.col("slot").alias("_s"), "value_type", "choices", "low", "high"))
    number = F.expr("try_cast(value AS DOUBLE)")
    size = F.length("value")
    good = (
        F.when(F.col("value_type") == "enum", F.array_contains("choices", F.col("value")))
        .when(F.col("value_type") == "time", F.col("value").rlike(r"^(?:[01][0-9]|2[0-3]):[0-5][0-9]\z"))
        .when(F.col("value_type") == "number", ~F.isnan(number) & (F.abs(number) < float("inf")) & (number >= F.coalesce("low", number)) & (number <= F.coalesce("high", number)))
        .when(F.col("value_type") == "text", (size >= F.coalesce("low", F.lit(1.0))) & (size <= F.coalesce("high", F.lit(512.0))))
    )
    joined = rows.join(s, (F.col("domain") == F.col("_d")) & (F.col("slot") == F.col("_s")), "left")
    return joined.select(*rows.columns, F.coalesce(good, F.lit(False)).alias("value_ok"))


def slot_names(tags: Column) -> Column:
    """Sorted distinct slot names of a tag sequence."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(tags, lambda t: t != "O"), lambda t: F.substring(t, 3, 64))))


def annotations_checked(rows: DataFrame) -> DataFrame:
    """``rows`` (domain, intent, tags) with ``problem``, the first that holds, or null.

    unknown-intent, unknown-slot (not in the domain), undeclared-slot (not of the intent), missing-slot.
    """
    spark = rows.sparkSession
    i = F.broadcast(intent_table(spark).select(F.col("domain").alias("_d"), F.col("intent").alias("_i"), F.col("slots").alias("_slots"), "required"))
    s = F.broadcast(slot_table(spark).groupBy(F.col("domain").alias("_d2")).agg(F.collect_list("slot").alias("_all")))
    joined = rows.join(i, (F.col("domain") == F.col("_d")) & (F.col("intent") == F.col("_i")), "left").join(s, F.col("domain") == F.col("_d2"), "left")
    used = slot_names(F.col("tags"))
    problem = (
        F.when(F.col("_i").isNull(), "unknown-intent")
        .when(F.size(F.array_except(used, "_all")) > 0, "unknown-slot")
        .when(F.size(F.array_except(used, "_slots")) > 0, "undeclared-slot")
        .when(F.size(F.array_except("required", used)) > 0, "missing-slot")
    )
    return joined.select(*rows.columns, problem.alias("problem"))
