"""The eleven checks of a corpus: one frame of files in, one frame of findings out.

files (ticker, path, resolved, text): every file of every ticker's folder, with the place it resolves to. Findings are
(check, ticker, path, severity, code, detail); `check` is the check's place in the fixed order below, and a secret or
credential is named, never shown.

1 containment, 2 artifacts' shapes, layers and commands, 3 sources' kinds and commands, 4 citations of pages, 5 citations
of assembled reports, 6 repeated exhibits, 7 markers left in reports, 8 verdict cards, 9 derivations, 10 secrets, 11
recorded requests.

What a file shows by itself comes from one projection of the files. References of checks 4, 5 and 9 are one frame that is
joined once with the artifacts of the ticker and once with the shared ones; a card is joined with its run's valuation
section. An artifact cited by very many pages meets them in a join whose other side has one row of it.

Cases: null text is empty. A path outside the layouts below is only held to 1 and 10. Malformed JSON is one finding of
its file; its other checks are left out. Equal rows give equal findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnbeck.functions import text as T
from tarnbeck.operators.credentials import credential_names
from tarnbeck.operators.findings import SECRETS
from tarnbeck.operators.gates import ANCHOR, MODEL_KINDS, SHARED, SOURCE_KINDS, good_ticker

#: What each producer's artifact needs.
NEEDS = {
    "fetch": ("id", "ticker", "title", "source", "url", "fetched_at", "as_of", "provider_tool", "fetch_cmd"),
    "compute": ("id", "ticker", "title", "source", "computed_at", "as_of", "provider_tool", "fetch_cmd"),
    "model": ("id", "ticker", "title", "source", "generated_at", "as_of"),
}
#: Fixed values of a card: divergence without a reconciliation, words of a reconciliation, slack of probabilities.
DIVERGENCE, WORDS, SLACK = 0.15, 40, 0.01
_WEIGHTED = r"(?i)\b(probability[- ]weighted|scenario[- ]weighted|expected value across (the )?scenarios)\b"
_FIELDS = sorted({"producer", *(f for fields in NEEDS.values() for f in fields)})
_META = ", ".join(f"{f} string" for f in _FIELDS) + ", derived_from array<string>"
_IMAGE = r"!\[[^\]\n]*\]\(([^)\n]+)\)"
_MARKER = r"\[\^[^\]\s]+\]"
_MATTER = r"(?s)\A---\n(.*?\n)---\n"
_RUN = r"^reports/([^/]+)/"


def _field(matter: Column, name: str) -> Column:
    return F.btrim(F.regexp_extract(matter, rf"(?m)^{name}:[ \t]*(.*)$", 1), F.lit(" '\""))


def _problem(when: Column, check: int, code: str, detail: Column | str) -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(when, F.struct(F.lit(check).alias("check"), F.lit(code).alias("code"), detail.alias("detail")))


def _each(when: Column, check: int, code: str, details: Column) -> Column:
    """A problem for each of an array of details."""
    some = F.transform(details, lambda d: F.struct(F.lit(check).alias("check"), F.lit(code).alias("code"), d.alias("detail")))
    return F.when(when, some).otherwise(F.array().cast("array<struct<check: int, code: string, detail: string>>"))


def parsed(files: DataFrame) -> DataFrame:
    """files with what their place and text say: what they are, their meta data or front matter, their id and run."""
    text, path = F.coalesce("text", F.lit("")), F.col("path")
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    kind = (
        F.when(path.rlike(r"^(structured|derived)/.*\.json$") & ~name.rlike(r"(^peers_user|\.urls)\.json$"), "artifact")
        .when(path.rlike(r"^sources/(archive/)?[^/]+\.md$") & (name != "00_manifest.md"), "source")
        .when(path.rlike(r"^wiki/.*\.md$") | path.rlike(r"^reports/[^/]+/sections/[^/]+\.md$") & ~name.rlike(r"\.critique\.md$"), "page")
        .when(path.rlike(r"^reports/[^/]+/report\.md$"), "report")
        .when(path.rlike(r"^reports/[^/]+/citation_map\.json$"), "map")
        .when(path.rlike(r"^reports/[^/]+/verdict\.json$"), "card")
    )
    rows = files.select("ticker", "path", "resolved", text.alias("text"), kind.alias("kind"), F.regexp_extract(path, _RUN, 1).alias("run"))
    raw = F.when(F.col("kind") == "artifact", F.get_json_object("text", "$._meta"))
    sound = raw.isNotNull() & F.get_json_object("text", "$.data").isNotNull()
    matter = F.regexp_extract("text", _MATTER, 1)
    layer = F.when(path.rlike(r"^(sources|structured)/"), "bronze").when(path.rlike("^derived/"), "silver")
    return rows.select("*", sound.alias("sound"), F.from_json(raw, _META).alias("meta"), matter.alias("matter"), layer.alias("layer"), F.regexp_extract(path, r"([^/]+?)\.(?:md|json)$", 1).alias("id"))


def _own_findings(files: DataFrame) -> DataFrame:
    """Checks 1, 2, 3, 6, 7, 10 and 11: what a file shows by itself."""
    c, kind = F.col, lambda k: F.col("kind").eqNullSafe(k)
    blank = lambda v: F.coalesce(v, F.lit("")) == ""
    meta = lambda f: c("meta")[f]
    shaped = kind("artifact") & c("sound")
    of = lambda p: shaped & meta("producer").eqNullSafe(p)
    made = [_problem(~F.startswith("resolved", F.concat("ticker", F.lit("/"))), 1, "path-containment", "outside the folder")]
    made += [_problem(kind("artifact") & ~F.coalesce("sound", F.lit(False)), 2, "producer-shape", "no _meta or data")]
    made += [_problem(shaped & c("layer").eqNullSafe("bronze") & meta("producer").eqNullSafe("model"), 2, "layer-boundary", "model output under structured")]
    made += [_problem(shaped & ~F.coalesce(meta("producer").isin(*NEEDS), F.lit(False)), 2, "producer-shape", "unknown producer")]
    made += [_problem(of(p) & blank(meta(f)), 2, "producer-shape", f"{p} without {f}") for p, fields in NEEDS.items() for f in fields]
    made += [_problem(of(p) & (F.coalesce(F.size(meta("derived_from")), F.lit(0)) <= 0), 2, "producer-shape", f"{p} without derived_from") for p in ("compute", "model")]
    made += [_problem(of(p) & ~blank(meta("url")), 2, "producer-shape", f"{p} with url") for p in ("compute", "model")]
    made += [_problem(of("model") & ~blank(meta("fetch_cmd")), 2, k, "model with fetch_cmd") for k in ("producer-shape", "fetch-cmd")]
    made += [_problem((of("fetch") | of("compute")) & blank(meta("fetch_cmd")), 2, "fetch-cmd", F.concat("layer", F.lit(" without fetch_cmd")))]
    source_kind = _field(c("matter"), "kind")
    made += [_problem(kind("source") & source_kind.isin(*MODEL_KINDS), 3, "layer-boundary", "model kind"), _problem(kind("source") & ~source_kind.isin(*MODEL_KINDS, *SOURCE_KINDS), 3, "layer-boundary", "unknown kind")]
    made += [_problem(kind("source") & blank(_field(c("matter"), "fetch_cmd")), 3, "fetch-cmd", "source without fetch_cmd")]
    markers = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(_MARKER), F.lit(0))))
    made += [_problem(kind("report") & (markers > 0), 7, "citation-unlinked", F.concat(markers.cast("string"), F.lit(" markers")))]
    scanned = c("path").rlike(r"\.(md|json)$")
    made += [_problem(scanned & c("text").rlike(p), 10, "secret", n) for n, p in SECRETS.items()]
    images = F.regexp_extract_all("text", F.lit(_IMAGE), F.lit(1))
    twice = F.filter(F.array_distinct(images), lambda i: F.size(F.filter(images, lambda j: i == j)) > 1)
    request = F.when(kind("artifact"), F.get_json_object("text", "$._meta.request")).when(kind("source"), _field(c("matter"), "request"))
    names = F.transform(credential_names(request), lambda n: F.concat(F.lit("names "), n))
    every = F.concat(F.array_compact(F.array(*made)), _each(kind("report"), 6, "exhibit-duplicated", twice), _each(shaped | kind("source"), 11, "secret", names))
    return files.select("ticker", "path", F.explode(every).alias("p")).select("p.check", "ticker", "path", "p.code", "p.detail")


def _references(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(check, ticker, path, id, shown) of all references, and the findings of reports whose numbers lead nowhere."""
    ref = lambda df, check, ids: df.select(F.lit(check).alias("check"), "ticker", "path", F.explode(F.array_distinct(ids)).alias("id")).withColumn("shown", F.col("id"))
    cited = ref(files.where("kind = 'page'"), 4, F.regexp_extract_all("text", F.lit(T.CITATION), F.lit(1)))
    built = F.regexp_extract_all(F.regexp_extract("matter", r"(?m)^built_from:[ \t]*\n((?:[ \t]*-.*\n|[ \t]+.*\n)*)", 1), F.lit(r"(?m)^[ \t]*-[ \t]*(?:id:[ \t]*)?['\"]?([A-Za-z0-9_.\-]+)"), F.lit(1))
    derived = ref(files.where("kind = 'artifact' AND sound"), 9, F.col("meta.derived_from")).union(ref(files.where("kind = 'page' AND path LIKE 'wiki/%'"), 9, built))
    numbers = F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(ANCHOR), F.lit(1)), F.regexp_extract_all("text", F.lit(T.CITATION), F.lit(1))))
    maps = files.where("kind = 'map'").select("ticker", "run", F.from_json("text", "map<string, string>").alias("map"), F.lit(True).alias("there"))
    reports = files.where("kind = 'report'").select("ticker", "run", "path", numbers.alias("cited")).where(F.size("cited") > 0).join(maps, ["ticker", "run"], "left")
    finding = lambda detail: (F.lit(5).alias("check"), "ticker", "path", F.lit("citation-unresolved").alias("code"), detail.alias("detail"))
    bare = reports.where("there IS NULL").select(*finding(F.lit("no citation_map.json")))
    broken = reports.where("there AND map IS NULL").select(*finding(F.lit("citation_map.json is no object")))
    each = reports.where("map IS NOT NULL").select("ticker", "path", "map", F.explode("cited").alias("shown"))
    number = F.col("shown").rlike("^[0-9]+$")
    led = each.select("ticker", "path", "shown", F.when(number, F.col("map")[F.col("shown")]).otherwise(F.col("shown")).alias("id"))
    unmapped = led.where("id IS NULL").select(*finding(F.concat(F.lit("not in the map: "), F.col("shown"))))
    return cited.union(derived).union(led.where("id IS NOT NULL").select(F.lit(5), "ticker", "path", "id", "shown")), bare.union(broken).union(unmapped)


def _reference_findings(files: DataFrame, references: DataFrame) -> DataFrame:
    """Checks 4, 5 and 9: a citation has to end at bronze, a derivation at any artifact, the ticker's own or a shared one."""
    known = files.where("layer IS NOT NULL AND id <> '' AND (kind IN ('artifact', 'source') OR path LIKE 'derived/%')").groupBy("ticker", "id").agg(F.min("layer").alias("own"))
    shared = known.where(F.col("ticker") == SHARED).select("id", F.col("own").alias("shared"))
    found = references.join(known, ["ticker", "id"], "left").join(shared, "id", "left").withColumn("layer", F.coalesce("own", "shared", F.lit("missing")))
    wrong = found.where(F.when(F.col("check") == 9, F.col("layer") == "missing").otherwise(F.col("layer") != "bronze"))
    code = F.when(F.col("check") == 9, "derivation-unresolved").otherwise("citation-unresolved")
    return wrong.select("check", "ticker", "path", code.alias("code"), F.concat("layer", F.lit(": "), "shown").alias("detail"))


def _card_findings(files: DataFrame) -> DataFrame:
    """Check 8: a run's card agrees with itself and with the run's valuation section (an absent one is empty)."""
    said = files.where(F.col("path").rlike(r"^reports/[^/]+/sections/valuation\.md$")).select("ticker", "run", F.col("text").alias("said"))
    cards = files.where("kind = 'card'").join(said, ["ticker", "run"], "left")
    number = lambda f: F.get_json_object("text", f"$.{f}").try_cast("double")
    odds = F.from_json(F.get_json_object("text", "$.scenario_probabilities"), "map<string, string>")
    c = F.col
    rows = cards.select(
        "ticker", "path", F.coalesce("said", F.lit("")).alias("said"), F.try_parse_json("text").isNotNull().alias("sound"), F.startswith(F.ltrim("text"), F.lit("{")).alias("object"),
        odds.alias("odds"), number("fair_value").alias("fair"), number("scenario_weighted_value").alias("weighted"), F.btrim(F.coalesce(F.get_json_object("text", "$.reconciliation"), F.lit(""))).alias("why"))
    total = F.aggregate(F.map_values("odds"), F.lit(0.0), lambda s, v: s + F.coalesce(v.try_cast("double"), F.lit(0.0)))
    good, apart = c("sound") & c("object"), F.abs(c("fair") - c("weighted")) / F.abs("fair") > DIVERGENCE
    odd = good & c("weighted").isNotNull() & (F.coalesce("fair", F.lit(0.0)) != 0) & apart
    digits = lambda v: F.regexp_replace(F.format_string("%.2f", v), r"\D", "")
    unnamed = lambda v: odd & (c("why") != "") & ~F.contains(F.regexp_replace("why", r"\D", ""), digits(c(v)))
    words = F.size(F.filter(F.split("why", r"\s+"), lambda w: w != ""))
    problems = {
        "unreadable": ~c("sound"),
        "no object": c("sound") & ~c("object"),
        "probabilities don't add up to 1": good & (F.size("odds") > 0) & (F.abs(total - 1) > SLACK),
        "weighted value only in the text": good & c("weighted").isNull() & c("said").rlike(_WEIGHTED),
        "weighted value without fair value": good & c("weighted").isNotNull() & (F.coalesce("fair", F.lit(0.0)) == 0),
        "no reconciliation": odd & (c("why") == ""),
        "short reconciliation": odd & (c("why") != "") & (words < WORDS),
        "reconciliation without fair_value": unnamed("fair"),
        "reconciliation without scenario_weighted_value": unnamed("weighted"),
        "reconciliation not in the section": odd & (c("why") != "") & ~F.contains("said", c("why")),
    }
    found = rows.select("ticker", "path", F.explode(F.array_compact(F.array(*[F.when(w, F.lit(n)) for n, w in problems.items()]))).alias("detail"))
    return found.select(F.lit(8).alias("check"), "ticker", "path", F.lit("verdict-unreconciled").alias("code"), "detail")


def validate(files: DataFrame) -> DataFrame:
    """check, ticker, path, severity, code, detail of every finding."""
    rows = parsed(files)
    references, unmapped = _references(rows)
    names = files.select("ticker").distinct().where(~F.coalesce(good_ticker(F.col("ticker")), F.lit(False)))
    odd_names = names.select(F.lit(1).alias("check"), "ticker", F.lit("").alias("path"), F.lit("path-containment").alias("code"), F.lit("name of the ticker").alias("detail"))
    every = odd_names.union(_own_findings(rows)).union(unmapped).union(_reference_findings(rows, references)).union(_card_findings(rows))
    return every.select("check", "ticker", "path", F.lit("error").alias("severity"), "code", "detail")


def has_errors(findings: DataFrame) -> bool:
    return not findings.where("severity = 'error'").isEmpty()
