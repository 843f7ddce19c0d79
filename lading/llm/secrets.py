"""Operator 1, secret scans: base patterns, and weak candidates linked to complementary parts by an interval join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import identified, settle

#: Base kinds in their order: pattern, the group whose length counts, its least length.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Weak kinds in their order, after the base ones. Each run of characters is tried from its start only; a name may follow
#: an underscore, as in DB_HOST, and a bare key an equals sign.
WEAK = {
    "endpoint": r"""(?i)(?<![A-Za-z0-9])(?:https?|ftp|sftp|ssh|mongodb|postgres(?:ql)?|mysql|redis|amqp)://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9])|(?<![A-Za-z0-9])(?:host|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}(?::[0-9]+)?""",
    "ident": r"""(?i)(?<![A-Za-z0-9])(?:user(?:name)?|login|client_?id|account|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+""",
    "weak_secret": r"""(?i)(?<![A-Za-z0-9])(?:pwd|pass|passphrase|auth|credential|private_?key|access_?key)s?["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/]*[g-zG-Z+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])""",
}
ORDER = [*BASE, *WEAK]
#: What part of a credential a kind is, and which parts complete it.
ROLE = {"assign": "secret", "access": "ident", "hex": "secret", "endpoint": "endpoint", "ident": "ident", "weak_secret": "secret"}
COMPLETES = {"secret": ("ident", "endpoint"), "ident": ("secret",), "endpoint": ("secret",)}
#: Parts at most so many characters apart are in one scope.
SCOPE = 200
#: So many reported spans may be broadcast.
FEW_SPANS = 100_000
MARK = "[SECRET]"

_SPAN = "struct<kind:int,from:int,to:int>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Pieces of a text that one fold appends to an array: appending copies, so this keeps the time linear in the matches.
CHUNK = 256


def _chunked(items: str, body: str) -> str:
    """SQL for the array of body for each run c of CHUNK elements of an array."""
    return f"transform(if(size({items}) > 0, sequence(0, (size({items}) - 1) div {CHUNK}), array()), n -> transform(array(slice({items}, n * {CHUNK} + 1, {CHUNK})), c -> {body})[0])"


def spans_sql(text: str, kind: str) -> str:
    """SQL for the array of spans (kind, from, to) of one kind: what lies between matches and the matches' own lengths
    add up to places in code points; matches that are too short are dropped after matching. Pieces are summed up in runs,
    and runs' starts first, so that the time is linear in the matches."""
    pattern, group, least = BASE.get(kind) or (WEAK[kind], 0, 1)
    p = _quoted(pattern)
    k = ORDER.index(kind)
    pieces = f"""zip_with(split({text}, {p}, -1), arrays_zip(regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group})),
      (gap, m) -> named_struct('gap', char_length(gap), 'len', coalesce(char_length(m['0']), 0), 'own', char_length(m['1'])))"""
    sums = _chunked("ps", "aggregate(c, 0, (a, x) -> a + x.gap + x.len)")
    starts = "aggregate(sums, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    spans = f"""aggregate(r.c, named_struct('at', r.start, 'spans', cast(array() as array<{_SPAN}>)),
      (a, x) -> named_struct('at', a.at + x.gap + x.len, 'spans',
        if(x.own >= {least}, concat(a.spans, array(named_struct('kind', {k}, 'from', a.at + x.gap, 'to', a.at + x.gap + x.len))), a.spans)),
      a -> a.spans)"""
    return f"""if({text} rlike {p},
      transform(array({pieces}), ps -> transform(array({sums}), sums -> transform(array({starts}), starts ->
        flatten(transform(filter(zip_with({_chunked("ps", "c")}, starts, (c, s) -> named_struct('c', c, 'start', s)), r -> r.c is not null), r -> {spans})))[0])[0])[0],
      cast(array() as array<{_SPAN}>))"""


def parts(text: str = "text") -> Column:
    """All parts of a credential in a whole text (null: empty), base and weak, as an array of (kind, from, to)."""
    return F.expr(f"transform(array(coalesce({text}, '')), t -> concat({', '.join(spans_sql('t', k) for k in ORDER)}))[0]")


def _of(kinds) -> Column:
    return F.filter("parts", lambda x: x["kind"].isin([ORDER.index(k) for k in kinds]))


def linked(found: DataFrame) -> DataFrame:
    """Rows (row_id, kind, from, to): the weak parts of found (row_id, parts) with a complementary part in their scope.

    An interval join: each part covers bins of SCOPE characters, a bin of a text keeps only the outermost places of
    each role, and a weak part is joined with the bins that its interval, widened by SCOPE, touches. A bin's summary
    has a constant size, so no pairs of parts are made, however many there are."""
    rows = found.where(F.size("parts") > 0).select("row_id", F.explode("parts").alias("p")).select("row_id", "p.kind", F.col("p.from").alias("lo"), F.col("p.to").alias("hi"))
    role = F.element_at(F.create_map(*(F.lit(x) for i, k in enumerate(ORDER) for x in (i, ROLE[k]))), F.col("kind"))
    bins = rows.select("*", role.alias("role"), F.explode(F.expr(f"sequence(lo div {SCOPE}, hi div {SCOPE})")).alias("bin"))
    outer = []
    for r in COMPLETES:
        outer.append(F.min(F.when(F.col("role") == r, F.greatest("lo", F.col("bin") * SCOPE))).alias(f"lo_{r}"))
        outer.append(F.max(F.when(F.col("role") == r, F.least("hi", (F.col("bin") + 1) * SCOPE))).alias(f"hi_{r}"))
    summary = bins.groupBy("row_id", "bin").agg(*outer)
    weak = rows.where(F.col("kind") >= len(BASE)).select("*", role.alias("role"), F.explode(F.expr(f"sequence(greatest(lo - {SCOPE}, 0) div {SCOPE}, (hi + {SCOPE}) div {SCOPE})")).alias("bin"))
    near = F.lit(False)
    for r, others in COMPLETES.items():
        for other in others:
            near = near | ((F.col("role") == r) & (F.col(f"hi_{other}") >= F.col("lo") - SCOPE) & (F.col(f"lo_{other}") <= F.col("hi") + SCOPE))
    return weak.join(summary, ["row_id", "bin"]).where(near).groupBy("row_id", "kind", "lo", "hi").agg(F.count("*").alias("bins")).select("row_id", "kind", F.col("lo").alias("from"), F.col("hi").alias("to"))


def _reported(found: DataFrame) -> DataFrame:
    """Rows (row_id, more): the linked weak parts of each text; marked for broadcast if they are counted to be few."""
    spans = settle(linked(found))
    grouped = spans.groupBy("row_id").agg(F.collect_list(F.struct("kind", "from", "to").cast(_SPAN)).alias("more"))
    return F.broadcast(grouped) if spans.count() <= FEW_SPANS else grouped


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep of each row of docs, and spans: the base spans and the linked weak ones by start, then kind.

    A null or empty text has none. Repeated rows are scanned each; ties, spans of one start, are in the kinds' order; an
    empty table gives no rows; the time is linear in a text's length and matches. docs may have any other columns."""
    found = settle(docs.select(*(F.col(f"`{c}`").alias(c) for c in keep), F.monotonically_increasing_id().alias("row_id"), parts().alias("parts")))
    joined = found.join(_reported(found), "row_id", "left")
    every = F.concat(_of(BASE), F.coalesce("more", F.array().cast(f"array<{_SPAN}>")))
    return joined.select(*keep, F.transform(F.sort_array(F.transform(every, lambda x: F.struct(x["from"].alias("from"), x["kind"].alias("kind"), x["to"].alias("to")))), lambda x: F.struct(x["kind"].alias("kind"), x["from"].alias("from"), x["to"].alias("to"))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["from"].cast("string"), x["to"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of docs (doc_id, text); see scan()."""
    base = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin([ORDER.index(k) for k in kinds]))
    return scan(docs, "doc_id").select(
        "doc_id", *(F.size(base(k)).cast("bigint").alias(f"n_{k}") for k in BASE),
        F.sha2(listed(base(*BASE)).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


#: Code points of a section of a text, to which places are found without going through the text from its start.
SECTION = 4096

_CUT = f"""
transform(array(regexp_extract_all(text, '(?s).{{1,{SECTION}}}', 0)), sections ->
  transform(array({_chunked("spans", "array_max(transform(c, x -> x.to))")}), tops ->
    transform(array(aggregate(tops, array(0), (a, x) -> concat(a, array(greatest(element_at(a, -1), x))))), starts -> concat(
      array_join(flatten(transform(filter(zip_with({_chunked("spans", "c")}, starts, (c, s) -> named_struct('c', c, 'start', s)), r -> r.c is not null), r ->
        transform(array(named_struct('base', r.start div {SECTION} * {SECTION}, 'part', array_join(slice(sections, r.start div {SECTION} + 1, element_at(r.c, -1).from div {SECTION} - r.start div {SECTION} + 1), ''))), at ->
          aggregate(r.c, named_struct('at', r.start, 'out', cast(array() as array<string>)),
            (a, x) -> named_struct('at', greatest(a.at, x.to), 'out', if(x.from >= a.at, concat(a.out, array(concat(substr(at.part, a.at - at.base + 1, x.from - a.at), '{MARK}'))), a.out)),
            a -> a.out))[0])), ''),
      substr(array_join(slice(sections, element_at(starts, -1) div {SECTION} + 1, size(sections)), ''), element_at(starts, -1) % {SECTION} + 1)))[0])[0])[0]
"""


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of its text, overlapping ones together, replaced by MARK; n_chars follows the new text.

    Spans alone are written and joined back to the rows, so texts stay where they are unless the rows with a span are too
    many to broadcast. Rows without a span, null texts too, are left as they are; repeated rows are cleaned each; an empty
    table gives no rows; any other columns are kept."""
    rows = identified(docs)
    found = settle(rows.select("row", parts("doc.text").alias("parts")).where(F.size("parts") > 0))
    every = F.concat(_of(BASE), F.coalesce("more", F.array().cast(f"array<{_SPAN}>")))
    spans = F.sort_array(F.transform(every, lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"))))
    cuts = settle(found.join(_reported(found.withColumnRenamed("row", "row_id")), F.col("row") == F.col("row_id"), "left").select("row", spans.alias("spans")).where(F.size("spans") > 0))
    few = F.broadcast(cuts) if (cuts.agg(F.sum(F.size("spans"))).first()[0] or 0) <= FEW_SPANS else cuts
    clean = rows.join(few, "row", "left").select("doc", F.col("doc.text").alias("text"), "spans").select("doc", F.when(F.col("spans").isNotNull(), F.expr(_CUT)).alias("clean"))
    now = {"text": F.coalesce("clean", F.col("doc.text"))}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.when(F.col("clean").isNull(), F.col("doc.n_chars")).otherwise(F.char_length("clean").cast("bigint"))
    return clean.select(*(now.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
