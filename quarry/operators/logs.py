"""LogQL over Spark: pipelines are column expressions over (ts_ns, line, labels); metrics are windows over them."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import numbers as N
from ..functions import template
from ..plans import logql as Q
from ..plans.lexer import QueryError
from .grid import Grid

ERROR, DETAILS = "__error__", "__error_details__"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: A key of logfmt and its value. Nothing is tried twice, so long quoted values need no deep stack.
PAIR = r'([^\s="]++)(?:=("[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\s"]*+))?'
#: Stages that can do with some labels as columns, and functions of ranges whose sums can be taken at once.
NARROW = {"line", "filter", "logfmt", "label_format", "drop", "keep", "distinct", "unwrap"}
SUMMED = {"count_over_time", "rate", "bytes_over_time", "bytes_rate", "sum_over_time"}
ANSI = r"\x1B\[[0-9;?]*[ -/]*[@-~]"


def _ip_number(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    number = reduce(lambda a, k: a * 256 + F.get(parts, F.lit(k)).try_cast("long"), range(4), F.lit(0).cast("long"))
    return F.when(ip.rlike(rf"^{IPV4}$"), number)


def ip_matches(ip: Column, spec: str) -> Column:
    """Whether an address is the one given, in the range a-b or in the prefix; null if it isn't an address."""
    if ":" in spec:
        return _ip6(spec)(ip)
    if "-" in spec:
        low, high = (int(ipaddress.IPv4Address(x.strip())) for x in spec.split("-"))
    else:
        net = ipaddress.IPv4Network(spec, strict=False)
        low, high = int(net[0]), int(net[-1])
    return _ip_number(ip).between(low, high)


def _let(x: Column, f) -> Column:
    """f of x, with x computed once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _ip6_hex(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, its zone left aside; null if it isn't one."""
    octets = rf"^(.*:){OCTET}\.{OCTET}\.{OCTET}\.{OCTET}\z"
    word = lambda x, k: F.lower(F.hex(F.regexp_extract(x, octets, k).try_cast("long") * 256 + F.regexp_extract(x, octets, k + 1).try_cast("long")))
    ip = _let(F.regexp_replace(ip, r"%[^%]+\z", ""), lambda x: F.when(x.rlike(octets), F.concat(F.regexp_extract(x, octets, 1), word(x, 2), F.lit(":"), word(x, 4))).otherwise(F.lower(x)))
    groups = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":", -1))
    wide = lambda x: F.array_join(F.transform(x, lambda g: F.lpad(g, 4, "0")), "")

    def joined(sides: Column) -> Column:
        left, right = F.get(sides, F.lit(0)), F.coalesce(F.get(sides, F.lit(1)), F.array().cast("array<string>"))
        n, parts = F.size(left) + F.size(right), F.size(sides)
        good = ((parts == 1) & (n == 8) | (parts == 2) & (n < 8)) & F.forall(F.flatten(sides), lambda g: g.rlike(r"^[0-9a-f]{1,4}\z"))
        return F.when(good, F.concat(wide(left), F.repeat(F.lit("0000"), 8 - n), wide(right)))

    return _let(F.transform(F.split(ip, "::", -1), groups), joined)


def _ip6(spec: str):
    if "-" in spec:
        low, high = (int(ipaddress.IPv6Address(x.strip())) for x in spec.split("-"))
    else:
        net = ipaddress.IPv6Network(spec, strict=False)
        low, high = int(net.network_address), int(net.broadcast_address)
    four = rf"^{OCTET}(?:\.{OCTET}){{3}}\z"
    return lambda ip: F.when(ip.rlike(four), F.lit(False)).otherwise(_let(_ip6_hex(ip), lambda x: x.between(f"{low:032x}", f"{high:032x}")))


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns, each computed once for a row: what is generated isn't copied into the filters and columns that use it."""
    made = F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.select(*(f"`{c}`" for c in df.columns if c not in columns), made)


def _mentioned(stages: tuple) -> set[str] | None:
    """All labels that stages name; null if a stage may use others, or isn't made for labels as columns."""
    out: set[str] = set()

    def tests(t) -> None:
        for x in (t.left, t.right) if isinstance(t, Q.Both) else ():
            tests(x)
        if not isinstance(t, Q.Both):
            out.add(t.label)

    for name, *args in stages:
        if name not in NARROW:
            return None
        if name == "filter":
            tests(args[0])
        elif name in ("drop", "keep", "distinct"):
            out.update(x[0] for x in args[0])
        elif name == "unwrap":
            out.add(args[0])
        elif name == "logfmt":
            out.update(label for label, _ in args[0])
        elif name == "label_format":
            for target, kind, text in args[0]:
                if kind == "template" and ("$" in text or re.search(r"\.(?![A-Za-z_])", text)):
                    return None
                out |= {target, *(re.findall(r"\.([A-Za-z_][\w.]*)", text) if kind == "template" else [text])}
    return out


def _labels(df: DataFrame) -> Column | L.Wide:
    """The map, or the columns that stand for it."""
    return F.col("labels") if "labels" in df.columns else L.Wide({c[1:]: F.col(f"`{c}`") for c in df.columns if c[0] == "@"})


def _with(df: DataFrame, labels: Column | L.Wide) -> DataFrame:
    return df.withColumns({f"@{n}": v for n, v in labels.items()}) if isinstance(labels, L.Wide) else _once(df, {"labels": labels})


def _failed(labels: Column | L.Wide, bad: Column, what: str) -> Column | L.Wide:
    """The first error of a row is noted, if it is asked for."""
    if isinstance(labels, L.Wide) and ERROR not in labels:
        return labels
    return L.choose(bad & ~L.has(labels, ERROR), L.put(labels, ERROR, F.lit(what)), labels)


def wildcard(pattern: str) -> str:
    """A regex for a line pattern with <_>."""
    return "(?s)^.*" + ".*".join(re.escape(p) for p in pattern.split("<_>")) + ".*$"


class LogEngine:
    """Queries over logs (ts_ns LONG, line STRING, labels MAP).

    An offset leaves the times of results as they are; with shifted_offsets they move with it.
    """

    def __init__(self, logs: DataFrame, shifted_offsets: bool = False):
        self.spark: SparkSession = logs.sparkSession
        self.shifted = shifted_offsets
        self.logs = logs.select("ts_ns", "line", "labels")

    # pipeline

    def pipeline(self, q: Q.Logs, start_ns: int | None = None, end_ns: int | None = None, only: tuple | None = None) -> DataFrame:
        """With only, labels that are neither in it nor in a stage needn't be made: the rest may be columns @name instead of the map."""
        df, named = self.logs, None if only is None else _mentioned(q.stages)
        if start_ns is not None:
            df = df.where((F.col("ts_ns") >= start_ns) & (F.col("ts_ns") <= end_ns))
        for name, op, text in q.matchers:
            df = df.where(self._stream(name, op, text))
        if named is not None:
            df = df.select("ts_ns", "line", *(F.col("labels")[n].alias(f"@{n}") for n in sorted(named | set(only))))
        for stage in q.stages:
            df = getattr(self, f"_{stage[0]}")(df, *stage[1:])
        return df

    def _stream(self, name: str, op: str, text: str) -> Column:
        value = L.get(F.col("labels"), name)
        if name in ("level", "detected_level"):
            return L.match(F.upper(value), op, text.upper() if op in ("=", "!=") else f"(?i:{text})")
        if name in ("trace_id", "span_id") and op in ("=", "!="):
            return L.match(F.lower(value), op, text.lower())
        if name == "msg" and op in ("=", "!="):
            hit = F.col("line").contains(text)
            return hit if op == "=" else ~hit
        return L.match(value, op, text)

    def _line(self, df: DataFrame, op: str, items: tuple) -> DataFrame:
        line, hits = F.col("line"), []
        for kind, text in items:
            if kind == "ip":
                tokens = F.regexp_extract_all(line, F.lit(IPV4 if ":" not in text else r"[0-9a-fA-F:]{2,}:[0-9a-fA-F:.]*"), F.lit(0))
                hits.append(F.exists(tokens, _ip_test(text)))
            elif op in ("|=", "!="):
                hits.append(line.contains(text))
            elif op in ("|~", "!~"):
                hits.append(line.rlike(L.java(text)))
            else:
                hits.append(line.rlike(wildcard(text)))
        hit = F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))
        return df.where(hit if op[0] == "|" else ~hit)

    def _filter(self, df: DataFrame, tree) -> DataFrame:
        """Lines for which it holds or can't be told; the latter get an error."""
        read: dict[str, Column] = {}
        labels = _labels(df)
        cond, bad = self._test(tree, read, labels)
        if not read:
            return df.where(cond)
        df = _once(df, read).where(cond)
        return _with(df, _failed(labels, reduce(lambda a, b: a | b, bad), "LabelFilterError")).drop(*read)

    def _test(self, t, read: dict[str, Column], labels: Column | L.Wide) -> tuple[Column, list]:
        """The condition, and which labels couldn't be read, over the columns that go into read."""
        if isinstance(t, Q.Both):
            (a, x), (b, y) = self._test(t.left, read, labels), self._test(t.right, read, labels)
            return (a & b if t.op == "and" else a | b), x + y
        value, there = L.get(labels, t.label), L.has(labels, t.label)
        if t.kind == "string":
            return L.match(value, "=" if t.op == "==" else t.op, t.value), []
        name = f"_n{len(read)}"
        made = F.col(name)
        if t.kind == "ip":
            read[name] = ip_matches(value, t.value)
            good = made if t.op in ("=", "==") else ~made
        else:
            read[name] = {"number": lambda: N.double_column(value), "duration": lambda: N.duration_column(value), "bytes": lambda: N.bytes_column(value)}[t.kind]()
            good = N.compare("==" if t.op == "=" else t.op, made, F.lit(float(t.value)))
        return there & F.coalesce(good, F.lit(True)), [there & made.isNull()]

    def _add(self, df: DataFrame, found: Column, what: str | None = None, nulls: bool = True) -> DataFrame:
        """Labels overwritten by a map, which may have null values for labels to leave out; null is an error that keeps the line."""
        df = _once(df, {"_f": F.map_filter(found, lambda k, v: v.isNotNull()) if nulls else found})
        labels = F.col("labels")
        failed = F.when(F.map_contains_key(labels, ERROR), labels).otherwise(L.put(labels, ERROR, F.lit(what))) if what else labels
        return _once(df, {"labels": F.when(F.col("_f").isNull(), failed).otherwise(L.merge(labels, F.col("_f")))}).drop("_f")

    def _json(self, df: DataFrame, extracts: tuple) -> DataFrame:
        whole = F.from_json("line", "map<string,string>", {"mode": "PERMISSIVE"})
        if not extracts:
            return self._add(df, L.label_names(whole), "JSONParserErr")
        made = [x for label, path in extracts for x in (F.lit(label), F.get_json_object("line", _json_path(path)))]
        return self._add(df, F.when(whole.isNotNull(), F.create_map(*made)), "JSONParserErr")

    def _logfmt(self, df: DataFrame, extracts: tuple) -> DataFrame:
        """The last of equal keys counts; a key that stands alone has the empty value."""
        labels, line = _labels(df), F.col("line")
        odd = ~line.rlike(r'\A[^"]*+(?:"[^"]*+"[^"]*+)*+\z')
        pairs = {"_k": F.regexp_extract_all("line", F.lit(PAIR), F.lit(1)), "_v": F.regexp_extract_all("line", F.lit(PAIR), F.lit(2))}
        if isinstance(labels, L.Wide):
            return self._logfmt_wide(df, labels, dict(extracts) if extracts else {n: n for n in labels}, pairs, odd)
        df = _once(df, pairs)
        plain = lambda v: F.when(v.startswith('"'), F.regexp_replace(v.substr(F.lit(2), F.length(v) - 2), r'\\(["\\])', "$1")).otherwise(v)
        at = lambda key: F.size("_k") - F.array_position(F.reverse("_k"), key).cast("int")
        value = lambda key: F.when(F.array_contains("_k", key), _let(F.get("_v", at(key)), plain))
        if extracts:
            found = F.create_map(*(x for label, key in extracts for x in (F.lit(label), value(key))))
        else:
            keys, quoted = F.array_distinct("_k"), F.col("line").contains('"')
            once = F.map_from_arrays("_k", F.when(quoted, F.transform("_v", plain)).otherwise(F.col("_v")))
            found = F.when(F.size(keys) == F.size("_k"), once).otherwise(F.map_from_arrays(keys, F.transform(keys, value)))
        return self._add(df, F.when(~odd, found), "LogfmtParserErr", bool(extracts)).drop("_k", "_v")

    def _logfmt_wide(self, df: DataFrame, labels: L.Wide, keys: dict[str, str], pairs: dict[str, Column], odd: Column) -> DataFrame:
        """Only the keys that are asked for are taken: each by a regex, and the last of equal ones.

        The regex runs over all pairs, unless the key stands once in the line, after a blank and before all quotes.
        Lines with a backslash, whose quoted values may have escapes, have all their pairs listed first. Each step is
        generated without lambdas, which Spark would not compile.
        """
        line, value = F.col("line"), r'(?:=(?:"[^"]*+"|[^\s"]*+))?'

        def held(key: str, at: Column) -> Column:
            if not re.fullmatch(r'[^ \t\n\x0b\f\r="]+', key):
                return F.lit("")
            own = rf'{re.escape(key)}(?![^\s="]){value}'
            blank = (at == 1) | line.substr(at - 1, F.lit(1)).isin(*" \t\n\x0b\f\r")
            clear = blank & ((F.col("_q") == 0) | (F.col("_q") > at)) & (F.position(F.lit(key), line, at + 1) == 0)
            every = F.regexp_extract("line", rf'\A(?:[\s="]++|({own})|[^\s="]++{value})*+', 1)
            return F.when(at > 0, F.when(clear, F.regexp_extract("line", own, 0)).otherwise(every)).otherwise("")

        def listed(key: str) -> Column:
            at = F.size("_k") - F.array_position(F.reverse("_k"), key).cast("int")
            return F.when(F.array_contains("_k", key), F.concat(F.lit(key + "="), F.get("_v", at))).otherwise("")

        places = {f"_a{i}": F.locate(key, line) for i, key in enumerate(keys.values())}
        made = {n: F.when(line.contains("\\"), c) for n, c in pairs.items()} | {"_odd": F.coalesce(odd, F.lit(True)), "_q": F.locate('"', line)} | places
        df = _once(df, made)
        df = _once(df, {f"_r{i}": F.when(F.col("_k").isNotNull(), listed(key)).otherwise(held(key, F.col(f"_a{i}"))) for i, key in enumerate(keys.values())}).drop(*pairs, "_q", *places)
        out = L.Wide(labels)
        for i, (label, key) in enumerate(keys.items()):
            token = F.col(f"_r{i}")
            raw = token.substr(F.lit(len(key) + 2), F.length(token))
            quoted = token.substr(F.lit(len(key) + 3), F.length(token) - (len(key) + 3))
            plain = F.when(raw.startswith('"'), F.when(quoted.contains("\\"), F.regexp_replace(quoted, r'\\(["\\])', "$1")).otherwise(quoted)).otherwise(raw)
            out[label] = F.when(F.col("_odd") | (token == ""), labels[label]).otherwise(plain)
        made = _failed(out, F.col("_odd"), "LogfmtParserErr")
        return _once(df, {f"@{n}": c for n, c in made.items() if c is not labels[n]}).drop("_odd", *(f"_r{i}" for i in range(len(keys))))

    def _regexp(self, df: DataFrame, pattern: str) -> DataFrame:
        names = [(n, re.compile(pattern).groupindex[n]) for n in re.compile(pattern).groupindex]
        plain = re.sub(r"\(\?P<[^>]+>", "(", pattern)
        made = [x for name, k in names for x in (F.lit(name), F.regexp_extract("line", plain, k))]
        return self._add(df, F.when(F.col("line").rlike(plain), F.create_map(*made)))

    def _pattern(self, df: DataFrame, pattern: str) -> DataFrame:
        """Captures bound before a mismatch stay: each capture has a regex of its own, over what stands before it."""
        parts = re.split(r"<([A-Za-z_][A-Za-z0-9_]*)>", pattern)
        made, prefix = [], "(?s)^" + re.escape(parts[0])
        for name, literal in zip(parts[1::2], parts[2::2], strict=True):
            capture = "(.*?)" + re.escape(literal) if literal else "(.*)$"
            if name != "_":
                hit = F.regexp_extract("line", prefix + capture, 1)
                made += [F.lit(name), F.when(F.col("line").rlike(prefix + capture), hit)]
            prefix += capture.replace("(", "(?:", 1)
        return self._add(df, F.create_map(*made)) if made else df

    def _unpack(self, df: DataFrame) -> DataFrame:
        df = _once(df, {"_j": F.from_json("line", "map<string,string>")})
        entry = F.col("_j")["_entry"]
        df = self._add(df, F.map_filter("_j", lambda k, v: k != "_entry"), "JSONParserErr")
        return df.withColumn("line", F.coalesce(entry, F.col("line"))).drop("_j")

    def _decolorize(self, df: DataFrame) -> DataFrame:
        return df.withColumn("line", F.regexp_replace("line", ANSI, ""))

    def _line_format(self, df: DataFrame, text: str) -> DataFrame:
        """Where the template fails the line stays, with an error."""
        df = _once(df, {"_t": template.compile(text, F.col("labels"), F.col("line"), F.col("ts_ns"))})
        labels, bad = F.col("labels"), F.col("_t").isNull() & ~F.map_contains_key("labels", ERROR)
        return _once(df, {"line": F.coalesce("_t", "line"), "labels": F.when(bad, L.put(labels, ERROR, F.lit("TemplateFormatErr"))).otherwise(labels)}).drop("_t")

    def _label_format(self, df: DataFrame, items: tuple) -> DataFrame:
        labels, columns = _labels(df), df.columns
        if isinstance(labels, L.Wide):
            df, before = df.withColumns({f"_before_{n}": v for n, v in labels.items()}), L.Wide({n: F.col(f"`_before_{n}`") for n in labels})
        else:
            df, before = df.withColumn("_before", labels), F.col("_before")
        for target, kind, text in sorted(items, key=lambda x: x[1] == "template"):
            if kind == "rename":
                made = L.drop(L.put(labels, target, L.get(labels, text)), [text] if text != target else [])
                df = _with(df, L.choose(L.has(labels, text), made, labels))
            else:
                df = _once(df, {"_t": template.compile(text, before, F.col("line"), F.col("ts_ns"))})
                df = _with(df, L.put(labels, target, F.col("_t"))).drop("_t")
        return df.select(*(f"`{c}`" for c in columns))

    def _drop(self, df: DataFrame, items: tuple) -> DataFrame:
        return _with(df, L.those(_labels(df), lambda k, v: ~_chosen(k, v, items)))

    def _keep(self, df: DataFrame, items: tuple) -> DataFrame:
        return _with(df, L.those(_labels(df), lambda k, v: _chosen(k, v, items)))

    def _distinct(self, df: DataFrame, items: tuple) -> DataFrame:
        """The first line of each value of each label, in the order of (ts_ns, line).

        Labels are looked at in turn: a line without the label stays and goes no further, one whose value was seen
        on a line that came as far goes. The first of a value is an aggregate, so few rows are shuffled; a set beside it,
        which stays empty, has Spark aggregate by hashing where it would sort all lines.
        """
        kept, labels = None, _labels(df)
        tie = labels.values() if isinstance(labels, L.Wide) else [L.key(labels)]
        for label, _, _ in items:
            without = df.where(~L.has(labels, label))
            kept = without if kept is None else kept.unionByName(without)
            have, order = df.where(L.has(labels, label)), F.struct("ts_ns", "line", *tie)
            row = F.struct(*(f"`{c}`" for c in df.columns))
            least = F.min(row) if isinstance(labels, L.Wide) and df.columns == ["ts_ns", "line", *(f"@{n}" for n in labels)] else F.min_by(row, order)
            first = have.groupBy(labels[label].alias("_l")).agg(least.alias("_r"), F.collect_set(F.lit(None).cast("int")).alias("_s")).where(F.size("_s") == 0)
            df = first.select("_r.*")
        return df if kept is None else kept.unionByName(df)

    def _unwrap(self, df: DataFrame, label: str, unit: str | None) -> DataFrame:
        labels = _labels(df)
        text = labels[label]
        made = {None: N.double_column(text), "bytes": N.bytes_column(text), "duration": N.duration_column(text), "duration_seconds": N.duration_column(text)}[unit]
        df = _once(df.where(L.has(labels, label)), {"_u": made})
        return _with(df, _failed(labels, F.col("_u").isNull(), "SampleExtractionErr")).withColumns({"value": F.coalesce("_u", F.lit(0.0)), "unwrapped": F.lit(label)}).drop("_u")

    # queries

    def query_range(self, query: str, start_ns: int, end_ns: int, step_ms: int = 1000, limit: int | None = None, forward: bool = False) -> DataFrame:
        tree = Q.parse(query)
        if isinstance(tree, Q.Logs):
            rows = self.pipeline(tree, start_ns, end_ns).select("ts_ns", "line", "labels")
            order = F.col("ts_ns").asc() if forward else F.col("ts_ns").desc()
            return rows.orderBy(order, "line").limit(limit) if limit else rows
        start, end = start_ns // 10**6 // step_ms * step_ms, end_ns // 10**6 // step_ms * step_ms + step_ms
        return self._metric(tree, Grid(start, end, step_ms))

    def lines(self, query: str, start_ns: int, end_ns: int, labels: tuple[str, ...]) -> DataFrame:
        """Entries with some labels as columns, empty where missing; what no stage and no column needs isn't made."""
        rows = self.pipeline(Q.parse(query), start_ns, end_ns, labels)
        return rows.select("ts_ns", "line", *(L.get(_labels(rows), n).alias(n) for n in labels))

    def query(self, query: str, at_ns: int) -> DataFrame:
        return self._metric(Q.parse(query), Grid(at_ns // 10**6, at_ns // 10**6, 1))

    def streams(self, rows: DataFrame) -> DataFrame:
        """Entries grouped by label set, in ascending time."""
        return rows.groupBy("labels").agg(F.array_sort(F.collect_list(F.struct("ts_ns", "line"))).alias("values"))

    def otel_lines(self, rows: DataFrame) -> DataFrame:
        """Entries whose line is a JSON object of the body (unless empty) and all labels."""
        body = F.when(F.col("line") != "", F.create_map(F.lit("body"), F.col("line"))).otherwise(L.empty())
        return rows.withColumn("line", F.to_json(L.merge(F.col("labels"), body)))

    def bucketed(self, query: str, start_ns: int, end_ns: int, step_ms: int) -> DataFrame:
        """sum by (...) of count, bytes or their rates as one aggregate for each step and label set; a rate divides after."""
        tree = Q.parse(query)
        inner = tree.expr if isinstance(tree, Q.VectorAgg) and tree.op == "sum" else None
        if not isinstance(inner, Q.RangeAgg) or inner.op not in ("count_over_time", "rate", "bytes_over_time", "bytes_rate") or inner.offset_ms or any(s[0] == "unwrap" for s in inner.logs.stages):
            raise QueryError("only sums of counts and bytes have a bucketed form")
        grid = Grid(start_ns // 10**6 // step_ms * step_ms, end_ns // 10**6 // step_ms * step_ms + step_ms, step_ms)
        rows = self.pipeline(inner.logs, (grid.start - inner.range_ms) * 10**6, grid.last * 10**6)
        labels = F.col("labels")
        group = L.drop(labels, list(tree.without)) if tree.without is not None else L.keep(labels, list(tree.by or ()))
        size = F.octet_length("line").cast("double") if inner.op.startswith("bytes") else F.lit(1.0)
        per = grid.fan_out(rows.select(group.alias("labels"), N.ceil_div(F.col("ts_ns"), 10**6).alias("ts_ms"), size.alias("value")), inner.range_ms).groupBy("labels", "step_ms").agg(F.sum("value").alias("value"))
        return per.withColumn("value", F.col("value") / (inner.range_ms / 1000.0)) if inner.op.endswith("rate") else per

    def _constant(self, grid: Grid, value: float) -> DataFrame:
        return grid.steps(self.spark).select(L.empty().alias("labels"), "step_ms", F.lit(value).alias("value"))

    def _metric(self, e, grid: Grid) -> DataFrame:
        if isinstance(e, Q.Literal | Q.Vector):
            return self._constant(grid, e.value)
        if isinstance(e, Q.RangeAgg):
            out = self._range(e, grid)
            return out.withColumn("step_ms", F.col("step_ms") - e.offset_ms) if self.shifted and e.offset_ms else out
        if isinstance(e, Q.Replace):
            target, to, source, pattern = e.args
            df, anchored = self._metric(e.expr, grid), L.whole(pattern)
            value = L.get(F.col("labels"), source)
            return df.withColumn("labels", F.when(value.rlike(anchored), L.put(F.col("labels"), target, F.regexp_replace(value, anchored, to))).otherwise(F.col("labels")))
        if isinstance(e, Q.VectorAgg):
            return self._aggregate(e, grid)
        return self._binary(e, grid)

    def _range(self, e: Q.RangeAgg, grid: Grid) -> DataFrame:
        near = (grid.start - e.range_ms - e.offset_ms) * 10**6, (grid.last - e.offset_ms) * 10**6
        rows = self.pipeline(e.logs, *near, None if e.op in ("absent_over_time", "rate_counter") else e.by)
        unwrapped = "value" in rows.columns
        if not unwrapped:
            rows = rows.withColumn("value", F.octet_length("line").cast("double") if e.op.startswith("bytes") else F.lit(1.0))
        labels = _labels(rows)
        wide = isinstance(labels, L.Wide)
        if wide:
            pass
        elif e.by is not None:
            rows = rows.withColumn("labels", L.keep(labels, list(e.by)))
        elif e.without is not None or unwrapped:
            gone = list(e.without or ())
            rows = rows.withColumn("labels", F.map_filter("labels", lambda k, v: ~(k.isin(gone) if gone else F.lit(False)) & ~((k == F.col("unwrapped")) if unwrapped else F.lit(False))))
        group = [f"`@{n}`" for n in e.by] if wide else ["labels"]
        rows = rows.select(*group, (N.ceil_div(F.col("ts_ns"), 10**6) + e.offset_ms).alias("ts_ms"), "ts_ns", "value")
        if e.op == "absent_over_time":
            equal = [F.lit(x) for n, op, t in e.logs.matchers if op == "=" for x in (n, t)]
            there = grid.fan_out(rows, e.range_ms).select("step_ms").distinct()
            return grid.steps(self.spark).join(there, "step_ms", "left_anti").select((F.create_map(*equal) if equal else L.empty()).alias("labels"), "step_ms", F.lit(1.0).alias("value"))
        seconds, v = e.range_ms / 1000.0, F.col("value")
        if e.op == "rate_counter":
            w = Window.partitionBy(L.key(labels)).orderBy("ts_ns")
            rows = rows.withColumns({"p": F.lag("value").over(w), "p_ts": F.lag("ts_ms").over(w)})
        made = {
            "count_over_time": lambda: F.count("*").cast("double"), "rate": lambda: F.sum(v) / seconds, "bytes_over_time": lambda: F.sum(v), "bytes_rate": lambda: F.sum(v) / seconds,
            "sum_over_time": lambda: F.sum(v), "avg_over_time": lambda: F.avg(v), "min_over_time": lambda: F.min(v), "max_over_time": lambda: F.max(v), "stddev_over_time": lambda: F.stddev_pop(v), "stdvar_over_time": lambda: F.var_pop(v),
            "first_over_time": lambda: F.min_by("value", "ts_ns"), "last_over_time": lambda: F.max_by("value", "ts_ns"), "quantile_over_time": lambda: N.quantile(e.parameter, v), "rate_counter": lambda: _counter(e.range_ms),
        }[e.op]()
        out = grid.fan_out(rows, e.range_ms).groupBy(*group, "step_ms").agg(made.alias("value"))
        return out.select(L.whole_map(_labels(out)).alias("labels"), "step_ms", "value") if wide else out

    def _aggregate(self, e: Q.VectorAgg, grid: Grid) -> DataFrame:
        inner = e.expr
        if e.op == "sum" and e.without is None and isinstance(inner, Q.RangeAgg) and inner.op in SUMMED and inner.by is None and inner.without is None:
            gone = [s[1] for s in inner.logs.stages if s[0] == "unwrap"]
            inner = replace(inner, by=tuple(n for n in dict.fromkeys(e.by or ()) if n not in gone))  # no groups that are only summed after
        df = self._metric(inner, grid)
        labels, v = F.col("labels"), F.col("value")
        group = L.drop(labels, list(e.without)) if e.without is not None else L.keep(labels, list(e.by or ()))
        if e.op in ("sort", "sort_desc"):
            return df.orderBy(F.isnan(v), v.asc() if e.op == "sort" else v.desc(), L.key(labels))
        if e.op in ("topk", "bottomk"):
            w = Window.partitionBy(L.key(group), "step_ms").orderBy(F.isnan(v), v.desc() if e.op == "topk" else v.asc(), L.key(labels))
            return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= e.k).drop("nth")
        made = {"sum": F.sum, "avg": F.avg, "count": lambda x: F.count("*").cast("double"), "max": N.most_number, "min": N.least_number, "stddev": F.stddev_pop, "stdvar": F.var_pop}[e.op](v)
        return df.withColumn("g", group).groupBy("g", "step_ms").agg(made.alias("value")).select(F.col("g").alias("labels"), "step_ms", "value")

    def _binary(self, e: Q.Binary, grid: Grid) -> DataFrame:
        comparison = e.op in ("==", "!=", ">", "<", ">=", "<=")

        def apply(df: DataFrame, x: Column, y: Column, kept: Column) -> DataFrame:
            if comparison and not e.bool_:
                return df.where(N.compare(e.op, x, y)).select("labels", "step_ms", kept.alias("value"))
            made = N.compare(e.op, x, y).cast("double") if comparison else N.arithmetic(e.op, x, y, zero_is_nan=True)
            return df.select("labels", "step_ms", made.alias("value"))

        if isinstance(e.left, Q.Literal) and not isinstance(e.right, Q.Literal):
            return apply(self._metric(e.right, grid), F.lit(e.left.value), F.col("value"), F.col("value"))
        if isinstance(e.right, Q.Literal):
            return apply(self._metric(e.left, grid), F.col("value"), F.lit(e.right.value), F.col("value"))
        a, b = (self._metric(x, grid).withColumn("k", L.key(F.col("labels"))) for x in (e.left, e.right))
        on = ["k", "step_ms"]
        if e.op in ("and", "unless"):
            return a.join(b.select(*on), on, "left_semi" if e.op == "and" else "left_anti").select("labels", "step_ms", "value")
        if e.op == "or":
            return a.unionByName(b.join(a.select(*on), on, "left_anti").select(*a.columns)).select("labels", "step_ms", "value")
        return apply(a.join(b.select(*on, F.col("value").alias("o")), on), F.col("value"), F.col("o"), F.col("value"))


def _ip_test(spec: str):
    return lambda x: F.coalesce(ip_matches(x, spec), F.lit(False))


def _json_path(path: str) -> str:
    return "$" + ("" if path.startswith("[") else ".") + path.replace('["', "['").replace('"]', "']")


def _chosen(k: Column, v: Column, items: tuple) -> Column:
    return reduce(lambda a, b: a | b, [(k == label) & (L.match(v, op, text) if op else F.lit(True)) for label, op, text in items])


def _counter(window: int) -> Column:
    """Extrapolated rate whose range starts a window before the first sample; under two samples it is 0."""
    v = F.col("value")
    inside = F.col("p_ts") > F.col("step_ms") - window
    first, last, n = F.min_by("value", "ts_ns"), F.max_by("value", "ts_ns"), F.count("*")
    first_ts, last_ts = F.min("ts_ms"), F.max("ts_ms")
    moved = last - first + F.sum(F.when(inside & N.compare(">", F.col("p"), v), F.col("p")).otherwise(0.0))
    took = (last_ts - first_ts) / 1000.0
    gap = took / F.when(n > 1, n - 1)
    before, after = F.lit(window / 1000.0), F.lit(0.0)
    before = F.when((moved > 0) & (first >= 0), F.least(before, took * first / F.when(moved > 0, moved))).otherwise(before)
    limit = gap * 1.1
    span = took + F.when(before < limit, before).otherwise(gap / 2) + after
    return F.when((n > 1) & (took > 0), moved * (span / F.when(took > 0, took)) / (window / 1000.0)).otherwise(0.0)
