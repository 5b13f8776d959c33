"""Secret scans: strong patterns alone, and weak parts of a credential only together.

A multipart credential is an identifier, a secret and perhaps an endpoint. Candidates of all kinds are found in one
pass over each text; an interval join within scopes (blocks between blank lines) then pairs each weak candidate with
complementary parts that are within ``reach`` characters of it, those of parts between them not counted. The join is a
RANGE frame over the candidates of a scope in order: it answers whether a partner exists without ever making the pairs.
Linked parts that follow one another within reach are one credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, pick

#: Kinds in the order that ties are listed; the first three are the strong (base) kinds.
ASSIGN = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
IDENTIFIER = r"(?<![A-Za-z0-9])(?:[cC][lL][iI][eE][nN][tT]_?[iI][dD]|[uU][sS][eE][rR](?:[nN][aA][mM][eE])?|[lL][oO][gG][iI][nN]|[aA][cC][cC][oO][uU][nN][tT](?:_?[iI][dD])?|[aA][cC][cC][eE][sS][sS]_?[kK][eE][yY]_?[iI][dD])[\"']?\x20?[:=]\x20?[\"']?[A-Za-z0-9_.@-]{3,}"
BLOB = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}"
ENDPOINT = r"(?<![A-Za-z0-9+.-])(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqps?|ssh)://[^\x20\x09-\x0D\"'<>]+"
BREAK = r"\n[\x20\t\r]*\n"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "identifier": IDENTIFIER, "blob": BLOB, "endpoint": ENDPOINT, "break": BREAK}
NAMES = list(KINDS)
BASE = NAMES[:3]
#: Characters between the parts of one credential that are in no part themselves.
REACH = 400


def _passes(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6
    if kind == "access":
        return F.length(match) >= 20
    if kind == "hex":
        return F.length(match) >= 24
    if kind == "blob":  # letters and digits in a mix that prose and rules of dashes don't have
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(match, ""))) >= 12)
    return F.lit(True)


def _found(text: Column, kind: str) -> Column:
    """Matches of a kind in order: place in the row, characters since the match before, length, whether it counts."""
    pattern = KINDS[kind]
    # a text without a match that is long enough has nothing to list
    sieve = {"hex": "[0-9a-f]{24}", "access": "AKIA[A-Z0-9]{16}"}.get(kind, pattern)
    listed = let(
        F.split(text, pattern),
        lambda gaps: F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda m, i: F.struct(F.lit(NAMES.index(kind)).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("n"), _passes(kind, m).alias("ok")),
        ),
    )
    return F.when(text.rlike(sieve), listed).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,n:int,ok:boolean>>"))


def _keys(id_: Column, text: Column) -> dict[str, Column]:
    """128 bits that name a row by its content; repeated rows share them."""
    return {"k1": F.xxhash64(id_, text), "k2": F.xxhash64(F.lit(7), text, id_)}


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Spans of each distinct (id, text) that has any: ``k1, k2, spans`` with ``spans`` an array of (start, kind, end, credential), sorted.

    Positions are code points, ends exclusive. Strong kinds are always reported. A weak blob needs an identifier within
    reach, a weak identifier a secret, an endpoint both; parts must be in the same scope. Weak candidates that a strong
    span overlaps from before are part of it and not listed. ``credential`` is (scope, number within the scope) of the
    chain of parts, each within reach of the one before, that holds an identifier and a secret; null for other spans.
    """
    rows = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    found = rows.select(*[c.alias(k) for k, c in _keys(F.col("id"), text).items()], "text", F.concat(*[_found(text, k) for k in NAMES[:-1]]).alias("found"))
    found = found.filter(F.exists("found", lambda x: x["ok"]))
    found = found.select("k1", "k2", F.explode(F.concat("found", _found(text, "break"))).alias("x")).select("k1", "k2", "x.*")
    # one shuffle: all that follows is by row
    found = found.repartition("k1", "k2").dropDuplicates(["k1", "k2", "kind", "i"])
    before = Window.partitionBy("k1", "k2", "kind").orderBy("i")
    placed = found.withColumn("start", F.sum(F.col("gap") + F.col("n")).over(before) - F.col("n")).filter("ok")
    placed = placed.withColumn("end", F.col("start") + F.col("n"))
    kind = F.col("kind")
    is_ = lambda *names: kind.isin([NAMES.index(x) for x in names])
    order = Window.partitionBy("k1", "k2").orderBy("start", "kind")
    placed = placed.withColumns({
        "scope": F.sum(is_("break").cast("int")).over(order),
        "base_end": F.max(F.when(is_(*BASE), F.col("end"))).over(Window.partitionBy("k1", "k2").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)),
    }).filter(~is_("break"))
    placed = placed.filter(is_(*BASE) | F.col("base_end").isNull() | (F.col("base_end") <= F.col("start")))
    # places are counted without the characters of parts, so that a long part sets nothing apart
    earlier = Window.partitionBy("k1", "k2", "scope").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("after", F.greatest("start", F.max("end").over(earlier)))
    placed = placed.withColumn("free", F.col("after") - F.coalesce(F.sum(F.greatest(F.col("end") - F.col("after"), F.lit(0))).over(earlier), F.lit(0)))
    near = Window.partitionBy("k1", "k2", "scope").orderBy("free").rangeBetween(-reach, reach)
    parts = {"id": is_("access", "identifier"), "secret": is_("assign", "hex", "blob")}
    placed = placed.withColumns({f"near_{k}": F.max(c.cast("int")).over(near) == 1 for k, c in parts.items()})
    linked = is_(*BASE) | (is_("blob") & F.col("near_id")) | (is_("identifier") & F.col("near_secret")) | (is_("endpoint") & F.col("near_id") & F.col("near_secret"))
    chain = Window.partitionBy("k1", "k2", "scope").orderBy("free", "start", "kind")
    gap = F.col("free") - F.lag("free").over(chain)
    placed = placed.filter(linked).withColumn("cut", F.coalesce((gap > reach).cast("int"), F.lit(0)))
    placed = placed.withColumn("number", F.sum("cut").over(chain))
    own = Window.partitionBy("k1", "k2", "scope", "number")
    whole = (F.max(parts["id"].cast("int")).over(own) == 1) & (F.max(parts["secret"].cast("int")).over(own) == 1)
    placed = placed.withColumn("credential", F.when(whole, F.struct(F.col("scope").cast("long").alias("scope"), F.col("number").cast("long").alias("number"))))
    span = F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end"), "credential")
    return placed.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _credentials(spans: Column) -> Column:
    """Each credential as ``scope:start+start+...``, comma-joined; scopes are counted from 0."""
    linked = F.filter(spans, lambda s: s["credential"].isNotNull())
    names = F.array_sort(F.array_distinct(F.transform(linked, lambda s: s["credential"])))
    starts = lambda c: F.array_join(F.transform(F.filter(linked, lambda s: s["credential"] == c), lambda s: s["start"].cast("string")), "+")
    return F.array_join(F.transform(names, lambda c: F.concat(c["scope"].cast("string"), F.lit(":"), starts(c))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """``id_col, n_assign, n_access, n_hex, base_sha256, spans, credentials`` of every row.

    ``credentials`` lists the starts of the parts that are linked to one another (see ``secret_spans``).

    Nulls: a null text is empty and has no spans (the digest is that of the empty text); a null id is kept. Repeated
    rows each get their row. An empty table gives no rows. Texts are read whole. Further columns are ignored.
    """
    rows = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    ids = rows.select("id", *[c.alias(k) for k, c in _keys(F.col("id"), F.col("text")).items()])
    out = ids.join(secret_spans(docs, id_col, text_col, reach), ["k1", "k2"], "left")
    out = out.withColumn("found", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,credential:struct<scope:bigint,number:bigint>>>")))
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    count = lambda i: F.size(F.filter("found", lambda s: s["kind"] == i)).cast("long")
    return out.select(F.col("id").alias(id_col), *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), _credentials(F.col("found")).alias("credentials"))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", reach: int = REACH, length_col: str | None = None) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mark`` (overlapping spans by one); other columns and rows as they are.

    ``length_col`` is set to the new length where a text changes. A null text stays null; a null id is kept. Repeated rows
    are each masked. An empty table gives no rows. Columns of ``docs`` must have distinct names.
    """
    key = {"id": F.col(id_col), "text": F.coalesce(F.col(text_col), F.lit(""))}
    keyed = docs.withColumns({f"_{k}": c for k, c in _keys(key["id"], key["text"]).items()})
    spans = secret_spans(docs, id_col, text_col, reach).withColumnsRenamed({"k1": "_k1", "k2": "_k2", "spans": "_spans"})
    text = F.col(text_col)

    def step(a: Column, s: Column) -> Column:
        more = F.when(s["start"] >= a["at"], F.concat(F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit(mark))).otherwise("")
        return F.struct(F.concat(a["out"], more).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    end = lambda a: F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, F.length(text)))
    clean = F.when(F.col("_spans").isNull(), text).otherwise(F.aggregate("_spans", start, step, end))
    out = keyed.join(spans, ["_k1", "_k2"], "left").withColumn(text_col, clean)
    if length_col:
        kind = dict(docs.dtypes)[length_col]
        out = out.withColumn(length_col, F.when(F.col("_spans").isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(kind)))
    return out.select(*docs.columns)
