"""Citations and bibliographies: inventories, audits, record lookup, claim items, verdicts, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.operators.matching import best_title_match, title_coverage

# -- placeholders ------------------------------------------------------------------------------

# Placeholder forms.
ID_GROUP = (r"(?i)\[PMIDs?\s*:\s*\d{1,9}(?!\d)(?:(?:\s*[,;]\s*|\s+)\d{1,9}(?!\d))*\s*[,;]?\s*\]")
KEY_FORM = r"(?i)\[REF\s*:\s*[^\[\]\n]+\]"
TEMPORARY = r"(?i)\{[^{}\n]+?#\s*\d+[^{}\n]*\}"
MALFORMED = r"(?i)\[(?:PMIDs?|REF)\b[^\]\n]*\]?"
CITE_FORM = r"^\s*(.*?)\s*(?:,\s*(\d{4}[a-z]?|n\.d\.))?\s*#\s*(\d+)\s*$"


def parse_temporary(body: Column) -> Column:
    """'Doe, 2020 #12;Roe, 2019 #7' -> cites; a backtick takes the next character literally."""
    held = F.regexp_replace(body, "`;", T.GROUP_MARK)
    pieces = F.transform(F.split(held, ";", -1), lambda p: F.translate(
        F.regexp_replace(p, "`(.)", "$1"), T.GROUP_MARK, ";"))
    part = lambda p, g: F.regexp_extract(p, CITE_FORM, g)
    return F.transform(pieces, lambda p: F.struct(
        F.when(p.rlike(CITE_FORM), part(p, 1)).alias("author"),
        F.when(part(p, 2) != "", part(p, 2)).alias("year"),
        F.when(p.rlike(CITE_FORM), part(p, 3)).alias("recnum"),
        F.when(~p.rlike(CITE_FORM), F.btrim(p)).alias("unparsed")))


def placeholder_inventory(paras: DataFrame, context: int = 80) -> DataFrame:
    """Every citation placeholder with kind, ids, key or cites, and context; malformed ones included.

    A cheap bracket test comes before any pattern.
    """
    text = F.col("text")
    tagged = lambda pattern, kind: F.transform(T.spans(text, pattern), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("body"), F.lit(kind).alias("kind")))
    good = F.concat(tagged(ID_GROUP, "pmid"), tagged(KEY_FORM, "ref"), tagged(TEMPORARY, "temporary"))
    def with_malformed(found):
        return F.concat(found, F.filter(tagged(MALFORMED, "malformed"), lambda m: ~F.exists(
            found, lambda g: (g["start"] <= m["start"]) & (m["start"] < g["end"]))))

    rows = paras.where(text.contains("[") | text.contains("{")).select(
        "doc_id", "para_idx", "text", F.explode(T.let(good, with_malformed)).alias("s"))
    ids = F.regexp_extract_all("s.body", F.lit(r"\d+"), F.lit(0))
    plural = (F.size(ids) > 1) | F.lower("s.body").startswith("[pmids")
    is_id, is_temp = F.col("s.kind") == "pmid", F.col("s.kind") == "temporary"
    return rows.select(
        "doc_id", "para_idx", F.col("s.start").alias("start"), F.col("s.end").alias("end"),
        F.when(is_id & plural, "pmids").otherwise(F.col("s.kind")).alias("kind"), F.col("s.body").alias("body"),
        F.when(is_id, ids).alias("ids"),
        F.when(F.col("s.kind") == "ref", F.btrim(F.regexp_extract("s.body", r"(?i)^\[REF\s*:\s*(.*?)\s*\]$", 1))).alias("key"),
        F.when(is_temp, parse_temporary(F.substr("s.body", F.lit(2), F.length("s.body") - 2))).alias("cites"),
        F.right(F.substr("text", F.lit(1), F.col("s.start")), F.lit(context)).alias("context_before"),
        F.substr("text", F.col("s.end") + 1, F.lit(context)).alias("context_after"))


def inventory_summary(items: DataFrame) -> DataFrame:
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return items.groupBy("doc_id").agg(
        n("pmid", "pmids", "ref", "temporary").alias("placeholders"), n("pmid", "pmids").alias("id_groups"),
        n("ref").alias("keys"), n("temporary").alias("temporary"), n("malformed").alias("malformed"),
        F.sum(F.coalesce(F.size("ids"), F.lit(0))).alias("id_occurrences"))


def ids_in_order(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct ids per document by first appearance, all of one source before the other.

    Both carry doc_id, id and an orderable ``pos``.
    """
    both = first.select("doc_id", "id", F.struct(F.lit(0).alias("source"), "pos").alias("at")).unionByName(
        second.select("doc_id", "id", F.struct(F.lit(1).alias("source"), "pos").alias("at")))
    return both.groupBy("doc_id", "id").agg(F.min("at").alias("at"))


# -- citation records --------------------------------------------------------------------------

# Fixed value: words that mark a corporate author.
ORGANISATION = (
    r"(?i)\b(collaborat\w*|committee|cent(?:er|re)s?|consortium|group|association|organi[sz]ation|institutes?|society|"
    r"network|investigators|council|agency|department|board|foundation|programme|program|task force|working party|"
    r"panel|alliance|federation|statistics|survey|office|ministry|commission|registry|trialists|coalition|union|"
    r"academy|college|services?|administration|bureau|authority|world health)\b")


def distinct_records(cites: DataFrame) -> DataFrame:
    """First citation of each (document, library, record number); map-side combined, no window."""
    fields = [c for c in cites.columns if c not in ("doc_id", "db_id", "recnum", "field_index")]
    return cites.groupBy("doc_id", "db_id", "recnum").agg(
        F.min_by(F.struct(*fields), "field_index").alias("r")).select("doc_id", "db_id", "recnum", "r.*")


def citation_census(cites: DataFrame) -> DataFrame:
    """Occurrences, distinct records, libraries and records without pages or DOI per document."""
    occurrences = cites.groupBy("doc_id", "db_id", "recnum").agg(
        F.count("*").alias("n"), F.min_by(F.struct("ref_type", "pages", "doi"), "field_index").alias("r"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return occurrences.groupBy("doc_id").agg(
        F.sum("n").alias("occurrences"), F.count("*").alias("records"),
        F.count_distinct("db_id").alias("libraries"),
        F.count_if(F.col("r.ref_type").startswith("17") & blank("r.pages")).alias("missing_pages"),
        F.count_if(blank("r.doi")).alias("missing_doi"))


def dangling_targets(links: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Links whose target is not defined (distinct)."""
    return links.select(*keys).distinct().join(targets.select(*keys).distinct(), keys, "left_anti")


def bibliography_entries(paras: DataFrame) -> DataFrame:
    """Number and DOI of each rendered entry."""
    text = F.btrim("text")
    number = F.regexp_extract(text, r"^\s*\[?(\d{1,4})[\].\t ]", 1).try_cast("int")
    doi = F.regexp_extract(text, r"\b(10\.\d{4,9}/[^\s\"<>]+[^\s\"<>.,;])", 1)
    return paras.where(F.col("is_bib") & (text != "")).select(
        "doc_id", "para_idx", number.alias("number"), text.alias("text"), F.when(doi != "", doi).alias("doi"))


def record_gaps(records: DataFrame) -> DataFrame:
    """Journal records without pages or identifier, and any record without DOI."""
    journal = F.btrim("ref_type") == "17"
    gaps = F.array_compact(F.array(
        F.when(journal & (F.coalesce("pages", F.lit("")) == ""), "pages"),
        F.when(T.normalise_doi("doi").isNull(), "doi"),
        F.when(journal & ~F.coalesce(F.btrim("pmid").rlike(r"^\d{1,9}$"), F.lit(False)), "pmid")))
    return records.select("doc_id", "db_id", "recnum", F.explode(gaps).alias("gap"))


def author_checks(records: DataFrame) -> DataFrame:
    """Corporate names kept whole, corporate suspects, and personal names without a comma."""
    author = F.col("author_name")
    kind = (F.when(author.endswith(","), "corporate").when(author.rlike(ORGANISATION), "corporate suspect")
            .when(~author.contains(",") & author.rlike(r"\S\s+\S"), "no comma"))
    return records.select("doc_id", "db_id", "recnum", F.explode("authors").alias("author_name")).select(
        "doc_id", "db_id", "recnum", "author_name", kind.alias("kind")).where("kind IS NOT NULL")


def collisions(records: DataFrame, keys: list[Column], names: list[str], member: str,
               distinct: bool = False) -> DataFrame:
    """Every record that shares a key with another one of its document: the key, the number of members, and the member, one row each.

    Groups are counted with map-side combination and meet their rows again in a join, so no group is collected. Records without a
    key are left out before anything is shuffled.
    """
    rows = records.select("doc_id", *[k.alias(n) for k, n in zip(keys, names)], F.col(member).alias("member")).where(
        " AND ".join(f"{n} IS NOT NULL" for n in names))
    rows = rows.distinct() if distinct else rows
    groups = rows.groupBy("doc_id", *names).agg(F.count("*").alias("members")).where("members > 1")
    return rows.join(groups, ["doc_id", *names]).select("doc_id", *names, "members", "member")


def author_year_collisions(records: DataFrame) -> DataFrame:
    return collisions(records, [F.lower(T.surname("author")), F.col("year")], ["author_label", "year"], "recnum")


def recnum_collisions(records: DataFrame) -> DataFrame:
    """One record number used in several libraries."""
    return collisions(records, [F.col("recnum")], ["recnum"], "db_id", distinct=True)


def duplicate_ids(records: DataFrame) -> DataFrame:
    """DOIs and PMIDs carried by several records."""
    doi = collisions(records, [T.normalise_doi("doi")], ["id"], "recnum").withColumn("kind", F.lit("doi"))
    pmid = F.btrim("pmid")
    ids = collisions(records, [F.when(pmid != "", pmid)], ["id"], "recnum").withColumn("kind", F.lit("pmid"))
    return doi.unionByName(ids)


def numbering_audit(entries: DataFrame) -> DataFrame:
    """Contiguity, order, gaps and duplicates of the typed numbers of each document."""
    order = Window.partitionBy("doc_id").orderBy("para_idx")
    rows = entries.where("number IS NOT NULL").withColumn("before", F.lag("number").over(order)).withColumn(
        "rank", F.row_number().over(order))
    per = rows.groupBy("doc_id").agg(
        F.count("*").alias("numbered"), F.bool_and(F.col("number") == F.col("rank")).alias("contiguous"),
        F.bool_and(F.coalesce(F.col("before") <= F.col("number"), F.lit(True))).alias("in_order"),
        F.max("number").alias("top"), F.array_distinct(F.sort_array(F.collect_list("number"))).alias("seen"))
    return per.select(
        "doc_id", "numbered", "contiguous", "in_order", (F.col("numbered") - F.size("seen")).alias("repeats"),
        F.array_except(F.sequence(F.lit(1), F.greatest("top", F.lit(1))), "seen").alias("gaps"))


# Where a rendered entry prints its year, by citation style.
_YEAR = r"(1[89]\d\d|20\d\d)"
YEAR_FORMS = {
    "author_date": r"\(" + _YEAR + r"[a-z]?\)",
    "vancouver": r"(?<!\d)" + _YEAR + r"[a-z]?(?:\s+[A-Z][a-z]{2}(?:[-/][A-Z][a-z]{2})?(?:\s+\d{1,2})?)?\s*;",
    "year_dot": r"[.,]\s" + _YEAR + r"[a-z]?[.,]",
}


def entry_year(text: Column, doi: Column, style: Column | None = None) -> Column:
    """(year, form) of an entry; the order of the forms follows the style, the last year is the fallback."""
    body = F.when(doi.isNotNull(), F.replace(text, doi, F.lit(" "))).otherwise(text)
    body = F.regexp_replace(body, r"(?i)(?:https?://|doi:\s*|10\.\d{4,9}/)\S+", " ")
    found = {k: F.regexp_extract(body, p, 1) for k, p in YEAR_FORMS.items()}
    years = F.regexp_extract_all(body, F.lit(r"(?<!\d)" + _YEAR + r"(?!\d)"), F.lit(0))

    def choose(order):
        out = None
        for name in order:
            case = F.struct(found[name].alias("year"), F.lit(name).alias("form"))
            out = F.when(found[name] != "", case) if out is None else out.when(found[name] != "", case)
        return out.when(F.size(years) > 0, F.struct(
            F.try_element_at(years, F.lit(-1)).alias("year"), F.lit("fallback").alias("form"))).otherwise(
            F.struct(F.lit("").alias("year"), F.lit("none").alias("form")))

    usual, dated = choose(["vancouver", "author_date", "year_dot"]), choose(["author_date", "year_dot", "vancouver"])
    if style is None:
        return usual
    return F.when(F.coalesce(style.rlike("(?i)apa|harvard|author|chicago|date"), F.lit(False)), dated).otherwise(usual)


# -- record index ------------------------------------------------------------------------------

def record_index(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by id, by DOI): first record wins; for a DOI an article record beats any other source.

    ``records(load_order, source, pmid, doi, ...)``. Aggregates keep the winner, so a popular key
    is combined on the map side.
    """
    fields = F.struct(*records.columns)
    article = F.col("source") == "article"
    by_id = records.where(article & F.col("pmid").isNotNull()).groupBy("pmid").agg(
        F.min_by(fields, "load_order").alias("r"))
    doi = T.normalise_doi("doi")
    by_doi = records.where(doi.isNotNull()).groupBy(doi.alias("doi")).agg(
        F.min_by(fields, F.struct((~article).cast("int"), "load_order")).alias("r"))
    return by_id.select("pmid", "r"), by_doi.select("doi", "r")


def spread_nulls(key: Column, *by: str) -> Column:
    """A join key whose NULLs, which match nothing, are dealt over all tasks instead of meeting in one."""
    return F.coalesce(key, F.concat(F.lit("\x00"), F.xxhash64(*by).cast("string")))


def lookup(requests: DataFrame, by_id: DataFrame, by_doi: DataFrame) -> DataFrame:
    """Attach the record found by id, else by DOI, as struct ``record`` (NULL when none)."""
    doi = T.normalise_doi("doi")
    ids = by_id.select(F.col("pmid").alias("_pmid"), F.col("r").alias("_by_id"))
    dois = by_doi.select(F.col("doi").alias("_doi"), F.col("r").alias("_by_doi"))
    own = [c for c in requests.columns if c not in ("pmid", "doi")] or ["pmid", "doi"]
    out = requests.join(ids, spread_nulls(F.col("pmid"), *own) == F.col("_pmid"), "left").join(dois, spread_nulls(doi, *own) == F.col("_doi"), "left")
    return out.withColumn("record", F.coalesce("_by_id", "_by_doi")).drop("_pmid", "_by_id", "_doi", "_by_doi")


def bibliography_audit(entries: DataFrame, records: DataFrame, failed_dois: DataFrame | None = None,
                       style: str = "") -> DataFrame:
    """Issues of each rendered entry against the fetched records; the first issue is the status.

    ``entries(doc_id, para_idx, number, text, doi)``, ``records(load_order, source, pmid, doi, title,
    years array<int>)``, ``failed_dois(doi)``.
    """
    year = entry_year(F.col("text"), F.col("doi"), F.lit(style))
    rows = entries.withColumn("doi_key", T.normalise_doi("doi")).withColumn("_year", year["year"])
    copies = rows.where("doi_key IS NOT NULL").groupBy("doc_id", "doi_key").agg(F.count("*").alias("copies"))
    rows = rows.join(copies, ["doc_id", "doi_key"], "left")
    _, by_doi = record_index(records)
    key = spread_nulls(F.col("doi_key"), "doc_id", "para_idx")
    rows = rows.join(by_doi.select(F.col("doi").alias("_doi"), F.col("r").alias("by_doi")), key == F.col("_doi"), "left").drop("_doi")
    bare = rows.where("doi_key IS NULL").select("doc_id", "para_idx", "text")
    titled = best_title_match(
        bare.withColumn("entry_id", F.struct("doc_id", "para_idx")),
        records.select(F.struct("load_order").alias("record_id"), "title"))
    titles = titled.select("entry_id.doc_id", "entry_id.para_idx", F.col("record_id.load_order").alias("load_order"))
    by_title = titles.join(records.select("load_order", F.struct(*records.columns).alias("by_title")), "load_order")
    rows = rows.join(by_title.select("doc_id", "para_idx", "by_title"), ["doc_id", "para_idx"], "left")
    rows = rows.withColumn("record", F.coalesce("by_doi", "by_title"))
    if failed_dois is not None:
        failed = failed_dois.select(T.normalise_doi("doi").alias("_doi"), F.lit(True).alias("failed")).distinct()
        rows = rows.join(failed, key == F.col("_doi"), "left").drop("_doi")
    else:
        rows = rows.withColumn("failed", F.lit(None).cast("boolean"))
    has = F.col("record").isNotNull()
    coverage = title_coverage(F.col("record.title"), F.col("text"))
    printed = F.col("_year").try_cast("int")
    near = F.exists("record.years", lambda y: F.abs(y - printed) <= 1)
    known = F.coalesce(F.size("record.years"), F.lit(0)) > 0
    issues = F.array_compact(F.array(
        F.when(F.col("doi_key").isNull(), "NO_DOI"),
        F.when(F.col("copies") > 1, "DUPLICATE_DOI"),
        F.when(~has, F.when(F.col("failed"), "FETCH_ERROR").otherwise("NO_RECORD")),
        F.when(has & (coverage < 0.5), "TITLE_MISMATCH"),
        F.when(has & printed.isNull(), "YEAR_NOT_FOUND").when(has & known & ~near, "YEAR_MISMATCH")))
    matched = F.when(F.col("by_doi").isNotNull(), "doi").when(F.col("by_title").isNotNull(), "title")
    return rows.select(
        "doc_id", "para_idx", "number", F.col("doi_key").alias("doi"), F.col("_year").alias("year"),
        matched.alias("matched_by"), issues.alias("issues"),
        F.coalesce(F.get(issues, 0), F.lit("OK")).alias("status"))


def fetch_status(requested: DataFrame, fetched: DataFrame, failed: DataFrame) -> DataFrame:
    """ok, no_abstract, not_found or fetch_error for each requested id."""
    got = fetched.groupBy("pmid").agg(F.bool_or(F.coalesce("abstract", F.lit("")) != "").alias("has_abstract"))
    bad = failed.select("pmid", F.lit(True).alias("failed")).distinct()
    status = (F.when(F.col("failed"), "fetch_error").when(F.col("has_abstract"), "ok")
              .when(F.col("has_abstract").isNotNull(), "no_abstract").otherwise("not_found"))
    return requested.select("pmid").distinct().join(got, "pmid", "left").join(bad, "pmid", "left").select(
        "pmid", status.alias("status"))


# -- claims and verdicts -----------------------------------------------------------------------

def claim_items(paras: DataFrame, markers: DataFrame, records: DataFrame | None = None,
                max_abstract_chars: int = 0) -> DataFrame:
    """The sentence that holds each citation, its neighbours, and the cited record.

    ``markers(doc_id, para_idx, field_index, position, pmid, doi)`` hold positions in the paragraph
    text. Sentence and marker meet on the paragraph, so the interval condition is checked on an
    array of that paragraph's sentences, not by a range join over the corpus.
    """
    text = paras.select("doc_id", "para_idx", "section", T.sentence_spans("text").alias("s"), F.col("text").alias("_t"))
    rows = markers.join(text, ["doc_id", "para_idx"])
    # the last sentence that starts before the marker; the first one when none does
    starts = F.size(F.filter("s", lambda x: x["start"] < F.col("position")))
    at = F.greatest(starts - 1, F.lit(0))
    sentence = lambda i: T.clean(F.coalesce(F.get("s", i)["text"], F.lit("")))
    rows = rows.select(
        *markers.columns, "section", F.when(F.size("s") == 0, T.clean("_t")).otherwise(sentence(at)).alias("claim"),
        F.when(at > 0, sentence(at - 1)).otherwise("").alias("context_before"),
        sentence(at + 1).alias("context_after"))
    if records is None:
        return rows
    by_id, by_doi = record_index(records)
    found = lookup(rows, by_id, by_doi)
    abstract = F.coalesce("record.abstract", F.lit(""))
    cut = F.lit(max_abstract_chars > 0) & (F.length(abstract) > max_abstract_chars)
    return found.withColumn("abstract_available", abstract != "").withColumn("abstract_truncated", cut).withColumn(
        "abstract", F.when(cut, F.left(abstract, F.lit(max_abstract_chars))).otherwise(abstract)).drop("record")


def claim_manifest(items: DataFrame) -> DataFrame:
    """Totals over claim items, one row: partial counts per key come first."""
    return items.agg(
        F.count_distinct("doc_id", "field_index").alias("fields"), F.count("*").alias("occurrences"),
        F.count_distinct("pmid").alias("records"),
        F.count_if(~F.col("abstract_available")).alias("without_abstract"),
        F.count_if("abstract_truncated").alias("truncated"))


VERDICTS = ("SUPPORTED", "WEAK", "MISMATCH", "UNVERIFIED_NO_ABSTRACT")   # fixed values
ACTIONS = ("REUSE", "ADD", "TEXT", "NONE")
CONFIDENCE = ("high", "medium", "low")


def validate_verdicts(verdicts: DataFrame, items: DataFrame) -> DataFrame:
    """Error list of each verdict; an empty list means valid, and only the first valid one per item counts.

    ``verdicts(file_order, field_index, cited, verdict, reason, suggested_action, confidence, tier)``,
    ``items(field_index, keys array<string>)``.
    """
    missing = lambda c: F.when(F.col(c).isNull(), f"missing '{c}'")
    enum = lambda c, allowed: F.when(F.col(c).isNotNull() & ~F.col(c).isin(*allowed), f"bad {c}")
    rows = verdicts.join(items.select("field_index", F.col("keys").alias("_keys")), "field_index", "left")
    unknown = F.array_except(F.coalesce("cited", F.array().cast("array<string>")), "_keys")
    errors = F.array_compact(F.array(
        *[missing(c) for c in ("field_index", "cited", "verdict", "reason", "suggested_action")],
        F.when(F.col("field_index") < 0, "bad field_index"), F.when(F.size("cited") == 0, "cited is empty"),
        enum("verdict", VERDICTS), F.when(F.btrim("reason") == "", "reason is empty"),
        enum("suggested_action", ACTIONS), enum("confidence", CONFIDENCE), enum("tier", (1, 2, 3)),
        F.when(F.col("field_index").isNotNull() & F.col("_keys").isNull(), "not an item"),
        F.when(F.size(unknown) > 0, "unknown key")))
    checked = rows.withColumn("errors", errors).drop("_keys")
    winner = checked.where(F.size("errors") == 0).groupBy("field_index").agg(F.min("file_order").alias("_first"))
    later = (F.size("errors") == 0) & (F.col("file_order") > F.col("_first"))
    return checked.join(winner, "field_index", "left").withColumn(
        "errors", F.when(later, F.array(F.lit("duplicate"))).otherwise(F.col("errors"))).drop("_first")


def verdict_tier() -> Column:
    """Tier of a valid verdict."""
    mismatch = (F.when(F.col("tier").isin(1, 2, 3), F.concat(F.lit("tier"), F.col("tier")))
                .when(F.col("suggested_action") == "TEXT", "tier3")
                .when(F.col("confidence") == "high", "tier1").otherwise("tier2"))
    return (F.when(F.col("verdict") == "MISMATCH", mismatch).when(F.col("verdict") == "WEAK", "weak")
            .when(F.col("verdict") == "UNVERIFIED_NO_ABSTRACT", "unverified")
            .when(F.col("verdict") == "SUPPORTED", "supported"))


def verdict_rollup(valid: DataFrame) -> DataFrame:
    """Counts by verdict, tier and action; the fields of a group stay rows (see ``valid``)."""
    return valid.groupBy("verdict", verdict_tier().alias("tier_name"), "suggested_action").agg(
        F.count("*").alias("n"), F.min("field_index").alias("first_field"))


def action_fields(valid: DataFrame) -> DataFrame:
    """Every field that a verdict asks to act on: (suggested_action, field_index), one row each."""
    return valid.where("suggested_action IS NOT NULL AND suggested_action <> 'NONE'").select("suggested_action", "field_index").distinct()


def not_judged(items: DataFrame, valid: DataFrame) -> DataFrame:
    return items.select("field_index").distinct().join(valid.select("field_index"), "field_index", "left_anti")


# -- resolution --------------------------------------------------------------------------------

def escape_cite(value: Column) -> Column:
    return F.regexp_replace(value, r"([;\\])", "`$1")


def resolve_placeholders(paras: DataFrame, library: DataFrame, skip_unmapped: bool = True) -> tuple[DataFrame, DataFrame]:
    """(paragraph texts with ids replaced by 'Surname, Year #rec' citations, ledger of groups).

    ``library(pmid, rec_number, surname, year, copies)``; ``copies`` > 1 marks an id with several
    records. Ids are looked up as rows; the replacements of one paragraph then come back as one
    ordered array and the text is rebuilt from its pieces.
    """
    text = F.col("text")
    items = paras.where(text.contains("[")).select(
        "doc_id", "para_idx", F.posexplode(T.spans("text", ID_GROUP)).alias("k", "s"))
    ids = F.regexp_extract_all("s.match", F.lit(r"\d+"), F.lit(0))
    rows = items.select("doc_id", "para_idx", "k", F.col("s.start").alias("start"), F.col("s.end").alias("end"),
                        F.col("s.match").alias("old"), ids.alias("ids"))
    each = rows.select("doc_id", "para_idx", "k", F.posexplode("ids").alias("pos", "pmid"))
    known = each.join(library, "pmid", "left")
    incomplete = (~F.coalesce(F.col("rec_number").cast("string").rlike(r"^\d+$"), F.lit(False))
                  | (F.coalesce("surname", F.lit("")) == "") | (F.coalesce(F.col("year").cast("string"), F.lit("")) == ""))
    error = (F.when(F.col("copies") > 1, "several records").when(F.col("rec_number").isNull(), "not in the library")
             .when(incomplete, "incomplete record"))
    cite = F.concat(escape_cite(F.col("surname")), F.lit(", "), escape_cite(F.col("year").cast("string")), F.lit(" #"),
                    F.col("rec_number"))
    per = known.groupBy("doc_id", "para_idx", "k").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", cite.alias("cite")))), lambda x: x["cite"]).alias("cites"),
        F.array_compact(F.transform(F.sort_array(F.collect_list(F.struct("pos", error.alias("e")))),
                                    lambda x: x["e"])).alias("errors"),
        F.count_distinct("pmid").alias("distinct_ids"))
    ledger = rows.join(per, ["doc_id", "para_idx", "k"])
    twice = F.when(F.col("distinct_ids") < F.size("ids"), F.array(F.lit("id appears twice"))).otherwise(
        F.array().cast("array<string>"))
    ledger = ledger.withColumn("errors", F.concat("errors", twice)).drop("distinct_ids").withColumn(
        "new", F.when(F.size("errors") == 0, F.concat(F.lit("{"), F.array_join("cites", ";"), F.lit("}"))))
    if not skip_unmapped:
        ledger = ledger.withColumn("new", F.when(
            F.size("errors") > 0, F.raise_error(F.concat(F.lit("unresolved: "), F.col("old")))).otherwise(F.col("new")))
    swaps = ledger.where("new IS NOT NULL").groupBy("doc_id", "para_idx").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "new"))).alias("swaps"))
    rebuilt = F.aggregate(
        "swaps", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")),
        lambda acc, s: F.struct(s["end"].alias("pos"), F.concat(
            acc["out"], F.substr("text", acc["pos"] + 1, s["start"] - acc["pos"]), s["new"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substr("text", acc["pos"] + 1, F.length("text"))))
    out = paras.join(swaps, ["doc_id", "para_idx"], "left").withColumn(
        "text", F.when(F.col("swaps").isNull(), F.col("text")).otherwise(rebuilt)).drop("swaps")
    return out, ledger


# -- links -------------------------------------------------------------------------------------

# Fixed value: a Markdown link.
LINK = r"\[[^\]\n]+\]\((?:<([^>\n]+)>|([^\s)\n]+))\)"
UNFINISHED = r"\b(?:TODO|TBD|FIXME|PLACEHOLDER)\b|\[(?:INSERT|REPLACE|FILL IN)\b[^\]\n]*\]"   # fixed values


def local_link_audit(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Relative links that leave their root or point at no file, and unfinished markers.

    ``docs(path, text)``, ``files(path)``; paths are relative to the root. Dot segments are resolved
    by an ordered fold over the (short) path.
    """
    links = F.concat(
        F.transform(T.spans("text", LINK), lambda s: F.struct(F.lit("link").alias("kind"), s["match"].alias("m"), s["start"].alias("at"))),
        F.transform(T.spans("text", UNFINISHED), lambda s: F.struct(F.lit("unfinished").alias("kind"), s["match"].alias("m"), s["start"].alias("at"))))
    rows = docs.select("path", "text", F.explode(links).alias("l"))
    line = F.length(F.regexp_replace(F.substr("text", F.lit(1), F.col("l.at")), "[^\n]", "")) + 1
    target = F.coalesce(*[F.when(F.regexp_extract("l.m", LINK, g) != "", F.regexp_extract("l.m", LINK, g)) for g in (1, 2)])
    rows = rows.select("path", F.col("l.kind").alias("kind"), line.alias("line"), F.col("l.m").alias("m"), target.alias("target"))
    bare = F.regexp_replace("target", "[?#].*$", "")
    local = ~F.col("target").rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)") & (bare != "")
    checked = rows.where((F.col("kind") == "unfinished") | local).withColumn("full", resolve_path(F.col("path"), bare))
    missing = checked.join(files.select(F.col("path").alias("full")).distinct().withColumn("found", F.lit(True)), "full", "left")
    problem = (F.when(F.col("kind") == "unfinished", "unfinished marker").when(F.col("full").isNull(), "leaves its root")
               .when(F.col("found").isNull(), "missing file"))
    return missing.select("path", "line", F.coalesce("target", "m").alias("item"), problem.alias("problem")).where(
        "problem IS NOT NULL")


def resolve_path(base: Column, link: Column) -> Column:
    """Path of a link relative to the folder of ``base``; NULL when it climbs out of the root or is absolute."""
    folder = F.regexp_replace(base, "[^/]*$", "")
    parts = F.split(F.concat(folder, link), "/")

    def step(acc, part):
        up = part == ".."
        return F.struct(
            (acc["out"] | (up & (F.size(acc["p"]) == 0))).alias("out"),
            F.when(up, F.slice(acc["p"], F.lit(1), F.greatest(F.size(acc["p"]) - 1, F.lit(0))))
            .when(part.isin("", "."), acc["p"]).otherwise(F.concat(acc["p"], F.array(part))).alias("p"))

    start = F.struct(F.lit(False).alias("out"), F.array().cast("array<string>").alias("p"))
    folded = F.aggregate(parts, start, step)
    return F.when(~link.startswith("/") & ~folded["out"], F.array_join(folded["p"], "/"))
