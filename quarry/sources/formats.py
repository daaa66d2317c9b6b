"""Log lines in known formats to records: generic JSON, logfmt, klog and zap development."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L

KLOG = r"^([IWEF])(\d{4} \d{2}:\d{2}:\d{2}\.\d+)\s+(\d+) ([^ \]]+:\d+)\] (.*)$"
ZAP = r"^(\S+)\t(DEBUG|INFO|WARN|ERROR|DPANIC|PANIC|FATAL)\t(?:([A-Za-z][\w.-]*)\t)?(?:(\S+\.go:\d+)\t)?([^\t]*)(?:\t(\{.*\}))?$"
PAIR = r'([A-Za-z_][\w.]*)=("(?:[^"\\]|\\.)*"|[^\s"]*)'
#: Names of fields that have a meaning, the likeliest first.
MESSAGE, LEVEL, TIME = ("message", "msg"), ("level", "lvl", "levelStr", "severity_text", "severity", "levelname"), ("timestamp", "@timestamp", "time", "ts", "t")
TRACE_ID, SPAN_ID = ("trace_id", "traceid", "traceID", "traceId"), ("span_id", "spanid", "spanID", "spanId")


def severity(text: Column) -> Column:
    """Trace, Debug, Info, Warn, Error or Fatal from the first letters of a level."""
    t = F.lower(F.trim(text))
    return F.when(t.startswith("trc") | t.startswith("trace"), "TRACE").when(t.startswith("d") & ~t.startswith("dpanic"), "DEBUG").when(t.startswith("i"), "INFO").when(t.startswith("w"), "WARN").when(t.startswith("e"), "ERROR").when(t.startswith("f") | t.startswith("p") | t.startswith("dpanic") | t.startswith("crit"), "FATAL")


def epoch_ns(text: Column) -> Column:
    """A time as digits (unit by their number: 10 s, 13 ms, 16 us, 19 ns), as seconds with a fraction, or in ISO form."""
    n = F.length(text)
    digits = text.rlike(r"^\d{10}$|^\d{13}$|^\d{16}$|^\d{19}$")
    scaled = F.when(digits, text.try_cast("long") * F.pow(F.lit(10.0), 19 - n).cast("long"))
    fraction = F.when(text.rlike(r"^\d{9,10}\.\d+$"), (text.try_cast("double") * 10**6).cast("long") * 1000)
    return F.coalesce(scaled, fraction, F.unix_micros(F.try_to_timestamp(text)) * 1000)


def detect(line: Column) -> Column:
    return F.when(line.rlike(KLOG), "klog").when(line.rlike(ZAP), "zap-development").when(line.startswith("{") & F.from_json(line, "map<string,string>").isNotNull(), "generic-json").when(line.rlike(rf"^\s*{PAIR}"), "logfmt")


def _first(fields: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(fields[n] for n in names))


def _unquoted(v: Column) -> Column:
    return F.when(v.startswith('"'), F.regexp_replace(v.substr(F.lit(2), F.length(v) - 2), r'\\(.)', "$1")).otherwise(v)


def parse(df: DataFrame, line: str = "line") -> DataFrame:
    """df with format, body, severity_text, parsed_ts_ns and attributes of each line; unknown lines are their own body."""
    c = F.col(line)
    text = F.when(c.rlike(KLOG), F.regexp_extract(c, KLOG, 5)).otherwise(c)
    keys = F.regexp_extract_all(text, F.lit(PAIR), F.lit(1))
    values = F.transform(F.regexp_extract_all(text, F.lit(PAIR), F.lit(2)), _unquoted)
    entries = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    pairs = F.map_from_entries(F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.lit(0), F.size(keys) - i - 1)), e["k"])))
    df = df.withColumn("format", detect(c))
    kind = F.col("format")
    json = F.from_json(F.when(kind == "zap-development", F.regexp_extract(c, ZAP, 6)).otherwise(c), "map<string,string>")
    df = df.withColumn("_f", F.when(kind.isin("generic-json", "zap-development"), json).when(kind.isin("logfmt", "klog"), pairs))
    f = F.col("_f")
    body = F.when(kind == "klog", F.coalesce(F.nullif(F.regexp_extract(c, KLOG[:-5] + r'"((?:[^"\\]|\\.)*)".*$', 5), F.lit("")), F.regexp_extract(c, KLOG, 5))).when(kind == "zap-development", F.regexp_extract(c, ZAP, 5)).when(kind.isNotNull(), F.coalesce(_first(f, MESSAGE), F.lit(""))).otherwise(c)
    level = F.when(kind == "klog", F.regexp_extract(c, KLOG, 1)).when(kind == "zap-development", F.regexp_extract(c, ZAP, 2)).otherwise(_first(f, LEVEL))
    time = F.when(kind == "zap-development", F.regexp_extract(c, ZAP, 1)).otherwise(_first(f, TIME))
    rest = F.map_filter(f, lambda k, v: ~k.isin(*MESSAGE, *LEVEL, *TIME, *TRACE_ID, *SPAN_ID))
    ids = {name: F.lower(F.when(v.rlike(f"^[0-9a-fA-F]{{{n}}}$"), v)) for name, v, n in (("trace_id", _first(f, TRACE_ID), 32), ("span_id", _first(f, SPAN_ID), 16))}
    return df.withColumns({"body": body, "severity_text": severity(level), "parsed_ts_ns": epoch_ns(time), "attributes": rest, **ids}).drop("_f")


def consume(records: DataFrame, format_attributes: tuple[str, ...] = ("log.format",), trigger_attributes: tuple[str, ...] = ("log.parse",)) -> DataFrame:
    """Records (ts_ns, body, severity_text, trace_id, span_id, attributes, scope, resource) with what their bodies say merged in.

    A body is parsed if an attribute names its format, or if a trigger attribute asks for the format to be found. What
    it says of time, severity and ids counts before the record's own; its fields join the attributes. A body that isn't
    of the format named stays as it is.
    """
    parsed = parse(records.select(F.struct(*records.columns).alias("r"), F.col("body").alias("line")))
    own = F.coalesce(*(F.col("r.attributes")[a] for a in format_attributes))
    asked = F.lit(False)
    for a in trigger_attributes:
        asked |= F.map_contains_key("r.attributes", a)
    use = F.col("format").isNotNull() & F.when(own.isNull(), asked).otherwise(F.array_contains(F.split(own, ","), F.col("format")))
    said = {"ts_ns": F.col("parsed_ts_ns"), **{c: F.col(c) for c in ("body", "severity_text", "trace_id", "span_id")}}
    merged = L.merge(F.col("r.attributes"), F.coalesce("attributes", L.empty()))
    return parsed.select(
        *(F.when(use, F.coalesce(v, F.col(f"r.{c}"))).otherwise(F.col(f"r.{c}")).alias(c) for c, v in said.items()),
        F.when(use, merged).otherwise(F.col("r.attributes")).alias("attributes"), F.col("r.scope").alias("scope"), F.col("r.resource").alias("resource"),
    )
