"""The item catalogue used by the cleaning, HTML, filter, score and rank queries.

The catalogue is derived from the whole ``part`` table: one assessment per part.  For the HTML
group the same rows are *rendered* by Spark into listing pages (12 rows a page plus edge rows) and
detail pages (four labelled blocks plus edge blocks), then extracted again, so extraction has an
exact oracle: the rows computed directly from ``part``.

``SRC`` holds the derivation as SQL expressions that mean the same in Spark SQL and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankframe import schemas as S
from rankframe.functions.text import (bm25_text, clean_text, decimal_digit_table, embedding_text, map_test_types,
                                      nan_safe_int, parse_duration, parse_list_field, parse_test_types, resolve_url, url_slug, yes_no_to_bool)
from rankframe.operators.clean import canonicalise, prepare_catalog
from rankframe.operators.extract import enrich_catalog, extract_details, extract_links, extract_listing, take_pages_until_repeat
from rankframe.plans.build import build_catalog
from rankframe.plans.common import sql_strip, t

ND_SRC, ND_DST = decimal_digit_table()
from rankframe.session import cut_lineage, scratch_path
from rankframe.sources.pages import land_pages, read_page_files, stream_page_files, write_manifest
from rankframe.sources.quarantine import quarantine, read_with_rejects, told
from rankframe.sources.tables import (read_catalog, read_catalog_json, read_vectors, write_catalog_json, write_table,
                                      write_vectors)

BASE_URL = "https://x.example"
LISTING_URL = BASE_URL + "/products/product-catalog/?type=1&start="
VIEW = BASE_URL + "/products/product-catalog/view/"
ROW_CLASS = "product-catalogue-training-calendar__row typ"

SRC = {
    "catalog_idx": "p_partkey",
    "assessment_id": "cast(p_partkey as string)",
    "assessment_name": "p_name",
    "slug": "concat(replace(p_name, ' ', '-'), '-', cast(p_partkey as string))",
    "assessment_url": f"concat('{VIEW}', replace(p_name, ' ', '-'), '-', cast(p_partkey as string), '/')",
    "remote_testing": "case when p_size % 2 = 0 then 'Yes' else 'No' end",
    "adaptive_irt": "case when p_size % 3 = 0 then 'Yes' else 'No' end",
    "code1": "substr('ABCDEKPS', cast(p_partkey % 8 as int) + 1, 1)",
    "code2": "substr('ABCDEKPS', cast(p_size % 8 as int) + 1, 1)",
    "code3": "case when p_partkey % 13 = 0 then 'Z' end",
    "description": "concat(p_name, ' ', lower(p_type), ' ', p_brand)",
    "level": ("case p_size % 4 when 0 then 'Entry-level' when 1 then 'Mid-Professional' "
              "when 2 then 'Senior' else 'Executive' end"),
    "language2": "case when p_partkey % 5 = 0 then null when p_partkey % 3 = 0 then 'French' "
                 "when p_partkey % 3 = 1 then 'German' else 'Spanish' end",
    "assessment_length": ("case when p_partkey % 11 = 0 then null when p_partkey % 19 = 0 then 'Variable' "
                          "when p_partkey % 7 = 0 then concat(cast(p_size as string), '-', cast(p_size + 10 as string), ' minutes') "
                          "else concat('Approximate Completion Time in minutes = ', cast(p_size as string)) end"),
    "has_detail": "p_partkey % 17 <> 0",
    "lang_has_p": "p_partkey % 31 <> 0",
    "label_twice": "p_partkey % 23 = 0",
    "label_case": "p_partkey % 29 = 0",
    "abs_href": "p_partkey % 9 = 0",
    "no_circle": "p_size % 5 = 0",
    "pg": "cast(floor(p_partkey / 12) as bigint)",
    "p_size": "p_size",
}
DERIVED = {
    "job_levels": "concat(level, ', ', p_brand, ', ')",
    "languages": "case when language2 is null then 'English (USA)' else concat('English (USA), ', language2) end",
}
SQL_SRC = ", ".join(f"{v} as {k}" for k, v in SRC.items()) + ", p_brand"
SQL_SOURCE = f"""src0 as (select {SQL_SRC} from part),
src as (select *, {', '.join(f'{v} as {k}' for k, v in DERIVED.items())} from src0)"""


def source(spark, sf):
    p = t(spark, sf, "part")
    s = p.selectExpr(*[f"{v} as {k}" for k, v in SRC.items()], "p_brand")
    s = s.selectExpr("*", *[f"{v} as {k}" for k, v in DERIVED.items()])
    return s.withColumn("codes", F.expr(
        "concat(case when code1 = code2 then array(code1) else array(code1, code2) end, "
        "case when code3 is null then cast(array() as array<string>) else array(code3) end)"))


def _block(label, body):
    return F.concat(F.lit(f'<div class="{ROW_CLASS}"><h4>{label}</h4>'), body, F.lit("</div>"))


def _p(text):
    return F.concat(F.lit("<p>  "), text, F.lit("\n</p>"))


def detail_pages(spark, sf):
    """One detail page per item with a page (items with ``has_detail`` false have none)."""
    s = source(spark, sf).where("has_detail")
    empty = F.lit("")
    html = F.concat(
        F.lit("<html><head><title>x</title><script>var s = '<p>';</script></head><body>"),
        F.when(F.col("label_case"), _block("description", _p(F.lit("wrong label case")))).otherwise(empty),
        _block("Description", _p(F.col("description"))),
        _block("Job levels", _p(F.col("job_levels"))),
        _block("Languages", F.when(F.col("lang_has_p"), _p(F.col("languages"))).otherwise(F.lit("<span>none</span>"))),
        F.when(F.col("assessment_length").isNotNull(),
               _block("Assessment length", _p(F.col("assessment_length")))).otherwise(empty),
        F.when(F.col("label_twice"), _block("Description", _p(F.lit("second block")))).otherwise(empty),
        F.lit("</body></html>"))
    return s.select(F.col("catalog_idx").alias("page_id"), F.col("assessment_url").alias("url"), html.alias("html"))


def _circle(flag):
    return (F.when(F.col(flag) == "Yes", F.lit('<span class="catalogue__circle -yes"></span>'))
            .when(F.col("no_circle"), F.lit(""))
            .otherwise(F.lit('<span class="catalogue__circle"></span>')))


def listing_pages(spark, sf, with_repeats=False):
    """Listing pages of 12 rows (plus a header row and an invalid 3-cell row per page).

    ``with_repeats`` appends the last page again and then the first page again, after the end: a
    take-while must stop at the repeat and never reach the page after it.
    """
    s = source(spark, sf)
    href = F.when(F.col("abs_href"), F.col("assessment_url")).otherwise(
        F.concat(F.lit("/products/product-catalog/view/"), F.col("slug"), F.lit("/")))
    spans = F.array_join(F.transform("codes", lambda c: F.concat(
        F.lit('<span class="product-catalogue__key">'), c, F.lit("</span>"))), "")
    row = F.concat(
        F.lit('<tr data-entity-id="'), F.col("assessment_id"),
        F.lit('"><td class="custom__table-heading__title"><a href="'), href, F.lit('"> '),
        F.col("assessment_name"), F.lit(" </a></td><td>"), _circle("remote_testing"), F.lit("</td><td>"),
        _circle("adaptive_irt"),
        F.lit('</td><td class="custom__table-heading__general product-catalogue__keys">'), spans,
        F.lit("</td></tr>\n"))
    pages = (s.select("pg", "catalog_idx", row.alias("row"))
             .groupBy("pg").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("catalog_idx", "row"))),
                                                         lambda x: x["row"]), "").alias("rows")))
    html = F.concat(F.lit("<html><body><table><tr><th>Title</th><th>Remote</th><th>Adaptive</th><th>Keys</th></tr>\n"),
                    F.col("rows"),
                    F.lit('<tr data-entity-id="bad"><td>a</td><td>b</td><td>c</td></tr>'),
                    F.lit('<tr data-entity-id="nolink"><td class="custom__table-heading__title">x</td><td></td><td></td><td></td></tr>'),
                    F.lit("</table></body></html>"))
    pages = pages.select(F.col("pg").alias("page_id"), html.alias("html"))
    if with_repeats:
        last = pages.agg(F.max("page_id")).first()[0]
        rep_last = pages.where(F.col("page_id") == last).select(F.lit(last + 1).cast("long").alias("page_id"), "html")
        rep_first = pages.where(F.col("page_id") == 0).select(F.lit(last + 2).cast("long").alias("page_id"), "html")
        pages = pages.unionByName(rep_last).unionByName(rep_first)
    return pages.select("page_id", (F.col("page_id") * 12 + 1).alias("start"),
                        F.concat(F.lit(LISTING_URL), (F.col("page_id") * 12 + 1).cast("string")).alias("url"),
                        "html")


def listing(spark, sf):
    return extract_listing(listing_pages(spark, sf), BASE_URL)


def built_catalog(spark, sf):
    """E1 on the rendered pages, with the repeated listing pages at the end."""
    return build_catalog(listing_pages(spark, sf, with_repeats=True), detail_pages(spark, sf), BASE_URL)


def catalog_typed(spark, sf):
    """The typed catalogue straight from ``part`` (equal to ``built_catalog``; checked by its oracle)."""
    s = source(spark, sf)
    enriched = s.select("assessment_id", "assessment_name", "assessment_url", "remote_testing", "adaptive_irt",
                        F.col("codes").alias("test_type_codes"), "catalog_idx",
                        F.lit(S.LISTING_CATEGORY).alias("category"),
                        F.when(F.col("has_detail"), F.col("description")).alias("description"),
                        F.when(F.col("has_detail"), F.col("job_levels")).alias("job_levels"),
                        F.when(F.col("has_detail") & F.col("lang_has_p"), F.col("languages")).alias("languages"),
                        F.when(F.col("has_detail"), F.col("assessment_length")).alias("assessment_length"))
    return canonicalise(prepare_catalog(enriched))


def _flat(df):
    return df.select(
        "catalog_idx", "category", "assessment_id", "assessment_name", "assessment_url", "remote_testing",
        "adaptive_irt", F.array_join("test_type_codes", "|").alias("test_type_codes"), "description",
        "assessment_length", "duration_minutes", F.array_join("test_types", "|").alias("test_types"),
        F.array_join("job_levels", "|").alias("job_levels"), F.array_join("languages", "|").alias("languages"),
        "remote_testing_bool", "adaptive_irt_bool")


# ------------------------------------------------------------------ registered queries
def q_pages_scan(spark, sf):
    return t(spark, sf, "pages").select("page_id", "url", F.length("html").alias("html_chars"))


def _landed(spark, sf):
    """The pages landed in bundles, with their manifest."""
    folder, manifest, pages = scratch_path(spark, "page-files"), scratch_path(spark, "page-manifest"), t(spark, sf, "pages")
    land_pages(pages, folder)
    write_manifest(pages, manifest)
    return folder, manifest


def q_page_files_links(spark, sf):
    """Links of the pages read from files: those of the table."""
    folder, manifest = _landed(spark, sf)
    return extract_links(read_page_files(spark, folder, manifest))


def q_page_files_stream(spark, sf):
    """The page files as a stream, with their URLs: all pages of the table (a file ends with a line feed)."""
    folder, manifest = _landed(spark, sf)
    sink, ck = scratch_path(spark, "page-stream"), scratch_path(spark, "page-stream-ckpt")
    q = (stream_page_files(spark, folder, manifest).select("page_id", "url", "html").writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink).select("page_id", "url", (F.length("html") - 1).alias("html_chars"))


def q_catalog_quarantine(spark, sf):
    """Catalogue records, some of them cut short, of another type or without their name, read with rejects;
    good rows and the quarantine's records, counted by reason."""
    path, bad = scratch_path(spark, "catalog-records"), scratch_path(spark, "catalog-rejects")
    cat, key = catalog_typed(spark, sf), F.col("catalog_idx")
    line = F.to_json(F.struct(*[F.when(key % 11 == 3, F.lit(None)).otherwise(F.col(c)).alias(c) if c == "assessment_name" else F.col(c) for c in cat.columns]))
    line = F.when(key % 11 == 5, F.substring(line, 1, 40)).when(key % 11 == 7, F.regexp_replace(line, '"catalog_idx":([0-9]+)', '"catalog_idx":"no $1"')).otherwise(line)
    cat.select(line.alias("value")).write.text(path)
    good, rejects = read_with_rejects(spark, path, cat.schema, required=("catalog_idx", "assessment_name"))
    quarantine(rejects, bad)
    kept = spark.read.schema("file string, record string, reason string").json(bad)
    return told(good, kept).join(good.agg(F.sum("catalog_idx").alias("s")).select("s", F.lit(None).cast("string").alias("r")), F.col("reason").eqNullSafe(F.col("r")), "left").select(
        F.coalesce("reason", F.lit("good")).alias("reason"), "n", F.coalesce("s", F.lit(0)).alias("sum_idx"))


def q_page_links(spark, sf):
    return extract_links(t(spark, sf, "pages"))


#: Relative links tried against every page's URL besides the links of the page.
TRIED_LINKS = ["#top", "?q=1", "../up", "./x/../y/", "..", "a//b", "/r/./s/../t?u=../v", ""]


def q_resolve_url(spark, sf):
    p = t(spark, sf, "pages")
    l = extract_links(p).join(p.select("page_id", F.col("url").alias("base")), "page_id")
    tried = p.select("page_id", F.posexplode(F.array(*[F.lit(x) for x in TRIED_LINKS])).alias("at", "href"), F.col("url").alias("base"))
    l = l.select("page_id", "pos", "href", "base").unionByName(tried.select("page_id", (-F.col("at") - 1).alias("pos"), "href", "base"))
    return l.select("page_id", "pos", resolve_url("href", F.col("base")).alias("url"))


def q_extract_listing(spark, sf):
    r = listing(spark, sf)
    return r.select("page_id", "row_pos", "category", "assessment_id", "assessment_name", "assessment_url",
                    "remote_testing", "adaptive_irt", F.array_join("test_type_codes", "|").alias("test_type_codes"))


def q_extract_details(spark, sf):
    return extract_details(detail_pages(spark, sf)).drop("page_id")


def q_pages_until_repeat(spark, sf):
    pages = listing_pages(spark, sf, with_repeats=True)
    rows = take_pages_until_repeat(extract_listing(pages, BASE_URL), pages.select("page_id", "start"))
    return rows.select("assessment_id", "start", "row_pos")


def q_enrich_left_join(spark, sf):
    e = enrich_catalog(listing(spark, sf), extract_details(detail_pages(spark, sf)))
    return e.select("assessment_id", "assessment_url", "description", "job_levels", "languages", "assessment_length")


def q_catalog_build(spark, sf):
    return _flat(built_catalog(spark, sf))


def q_catalog_json_roundtrip(spark, sf):
    path = scratch_path(spark, "catalog-json")
    write_catalog_json(built_catalog(spark, sf), path)
    return _flat(read_catalog_json(spark, path))


def q_clean_text(spark, sf):
    conv = t(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"),
                                               clean_text("text").alias("clean"))
    raw = source(spark, sf).select(F.col("assessment_id").alias("key"),
                                   clean_text(F.concat(F.lit("\t "), F.col("description"), F.lit(" \n"))).alias("clean"))
    return conv.unionByName(raw)


def q_parse_duration(spark, sf):
    s = source(spark, sf).select(F.col("assessment_id").alias("key"), parse_duration("assessment_length").alias("minutes"))
    d = t(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("key"),
                                         parse_duration("text").alias("minutes"))
    return s.unionByName(d)


def q_map_test_types(spark, sf):
    return source(spark, sf).select("catalog_idx", F.array_join(map_test_types("codes"), "|").alias("test_types"))


def q_split_list(spark, sf):
    s = source(spark, sf)
    return s.select("catalog_idx", F.array_join(parse_list_field("job_levels"), "|").alias("job_levels"),
                    F.size(parse_list_field("languages")).alias("n_languages"))


def q_yes_no(spark, sf):
    s = source(spark, sf)
    raw = F.expr("case catalog_idx % 4 when 0 then upper(remote_testing) when 1 then lower(adaptive_irt) "
                 "when 2 then 'maybe' else null end")
    return s.select("catalog_idx", yes_no_to_bool("remote_testing").alias("remote"),
                    yes_no_to_bool(raw).alias("mixed"))


def q_url_slug(spark, sf):
    s = source(spark, sf).select(
        F.col("assessment_id").alias("key"),
        url_slug(F.expr("case catalog_idx % 3 when 0 then assessment_url "
                        "when 1 then concat(upper(assessment_url), '//') "
                        f"else replace(assessment_url, '{BASE_URL}/', '{BASE_URL}/solutions/') end")).alias("slug"))
    p = t(spark, sf, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("key"),
                                     url_slug("url").alias("slug"))
    return s.unionByName(p)


def q_embedding_text(spark, sf):
    c = catalog_typed(spark, sf)
    return c.select("catalog_idx", embedding_text("assessment_name", "description", "test_types",
                                                  "job_levels").alias("text"))


def q_bm25_text(spark, sf):
    c = catalog_typed(spark, sf)
    return c.select("catalog_idx", bm25_text("full").alias("full"), bm25_text("name_desc").alias("name_desc"),
                    bm25_text("name_desc_types").alias("name_desc_types"))


def q_pages_stream_dedupe(spark, sf):
    """M2 registered: the rendered listing pages (with the repeated pages) land as parquet files and
    are read as a stream, one file per trigger; repeated pages are dropped by signature state."""
    from rankframe.streaming.recommend_stream import new_listing_pages
    folder, sink, ck = (scratch_path(spark, n) for n in ("pages-landing", "pages-new", "pages-ckpt"))
    # the stream takes one file per trigger in arrival order, so the first copy of a repeated page is
    # the one kept
    pages = cut_lineage(listing_pages(spark, sf, with_repeats=True), "pages-rendered")
    last = pages.agg(F.max("start")).first()[0] or 0
    # each landing is written by as many tasks as its pages need; the two repeated pages come last
    for lo, hi in ((0, last - 12), (last - 12, last + 1)):
        pages.where((F.col("start") >= lo) & (F.col("start") < hi)).write.mode("append").parquet(f"{folder}/at={lo}")
    stream = (spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(folder))
    q = (new_listing_pages(stream, BASE_URL).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink).select("assessment_id", "start", "row_pos")


def q_pages_stream_until_repeat(spark, sf):
    """M2: the listing pages land in three parts, out of order, and are read as a stream of a few files
    per trigger; the stream takes pages until the first repeat."""
    from rankframe.streaming.listing_stream import pages_until_repeat_stream, rocksdb_state
    folder, sink, ck = (scratch_path(spark, n) for n in ("listing-landing", "listing-taken", "listing-ckpt"))
    pages = cut_lineage(listing_pages(spark, sf, with_repeats=True), "pages-rendered")
    for part in (2, 0, 1):
        pages.where(F.pmod("start", F.lit(36)) == 12 * part + 1).write.parquet(f"{folder}/at={part}")
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/at=*")
    with rocksdb_state(spark):
        q = (pages_until_repeat_stream(stream, BASE_URL).writeStream.format("parquet").option("path", sink)
             .option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.parquet(sink).select("assessment_id", F.col("start").cast("int").alias("start"), "row_pos")


def q_catalog_table_roundtrip(spark, sf):
    """The typed catalogue through the table sink and the typed scan."""
    path = scratch_path(spark, "catalog-table")
    write_table(catalog_typed(spark, sf), path)
    return _flat(read_catalog(spark, path))


def q_vectors_roundtrip(spark, sf):
    """Every embedding through the vector sink and scan."""
    path = scratch_path(spark, "vectors")
    write_vectors(t(spark, sf, "embeddings").withColumnRenamed("vec_id", "catalog_idx"), path)
    return read_vectors(spark, path).select("catalog_idx", F.posexplode("embedding").alias("i", "x")).select(
        "catalog_idx", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


def q_catalog_json_array(spark, sf):
    """Files that each hold one indented JSON array of records."""
    path = scratch_path(spark, "catalog-array")
    rows = catalog_typed(spark, sf)
    record = F.to_json(F.struct(*rows.columns), {"pretty": "true", "ignoreNullFields": "false"})
    files = (rows.select(F.floor(F.col("catalog_idx") / 1000).alias("file"), record.alias("record")).groupBy("file")
             .agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("record"), ",\n"), F.lit("\n]")).alias("value")))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return _flat(read_catalog_json(spark, path, array=True))


def q_enrich_duplicate_details(spark, sf):
    """J1 with a second detail page for every URL: the page with the smaller id counts, rows stay single."""
    d = extract_details(detail_pages(spark, sf))
    again = d.select((F.col("page_id") + 1_000_000_000).alias("page_id"), "assessment_url", F.lit("later page").alias("description"),
                     "job_levels", "languages", "assessment_length")
    e = enrich_catalog(listing(spark, sf), again.unionByName(d))
    return e.select("assessment_id", "assessment_url", "description", "job_levels", "languages", "assessment_length")


def q_revive_list_text(spark, sf):
    """The stored text form of the code list, parsed and mapped."""
    text = F.concat(F.lit("['"), F.array_join("codes", "', '"), F.lit("']"))
    return source(spark, sf).select("catalog_idx", F.array_join(parse_test_types(text), "|").alias("test_types"))


def q_nan_safe_int(spark, sf):
    """A float column with NaN and NULL."""
    x = F.expr("case when p_partkey % 5 = 0 then double('NaN') when p_partkey % 7 = 0 then null else p_size + 0.75D end")
    return t(spark, sf, "part").select("p_partkey", nan_safe_int(x).alias("minutes"))


QUERIES = {
    "pages_scan": q_pages_scan,
    "pages_stream_dedupe": q_pages_stream_dedupe,
    "pages_stream_until_repeat": q_pages_stream_until_repeat,
    "page_files_links": q_page_files_links,
    "page_files_stream": q_page_files_stream,
    "catalog_quarantine": q_catalog_quarantine,
    "page_links": q_page_links,
    "resolve_url": q_resolve_url,
    "extract_listing": q_extract_listing,
    "extract_details": q_extract_details,
    "pages_until_repeat": q_pages_until_repeat,
    "enrich_left_join": q_enrich_left_join,
    "catalog_build": q_catalog_build,
    "catalog_json_roundtrip": q_catalog_json_roundtrip,
    "clean_text": q_clean_text,
    "parse_duration": q_parse_duration,
    "map_test_types": q_map_test_types,
    "split_list": q_split_list,
    "yes_no": q_yes_no,
    "url_slug": q_url_slug,
    "embedding_text": q_embedding_text,
    "bm25_text": q_bm25_text,
    "catalog_table_roundtrip": q_catalog_table_roundtrip,
    "vectors_roundtrip": q_vectors_roundtrip,
    "catalog_json_array": q_catalog_json_array,
    "enrich_duplicate_details": q_enrich_duplicate_details,
    "revive_list_text": q_revive_list_text,
    "nan_safe_int": q_nan_safe_int,
}

# ------------------------------------------------------------------ DuckDB oracle SQL
TYPE_NAME = ("case {c} when 'A' then 'Ability & Aptitude' when 'B' then 'Biodata & Situational Judgement' "
             "when 'C' then 'Competencies' when 'D' then 'Development & 360' when 'E' then 'Assessment Exercises' "
             "when 'K' then 'Knowledge & Skills' when 'P' then 'Personality & Behavior' "
             "when 'S' then 'Simulations' else {c} end")
CODES = ("(case when code1 = code2 then [code1] else [code1, code2] end || "
         "case when code3 is null then []::varchar[] else [code3] end)")
TYPES_JOINED = (f"concat_ws('|', {TYPE_NAME.format(c='code1')}, "
                f"case when code1 <> code2 then {TYPE_NAME.format(c='code2')} end, code3)")
DURATION = "case when assessment_length is null or assessment_length = 'Variable' then null else p_size end"
TYPED = f"""{SQL_SOURCE},
typed as (select catalog_idx, '{S.LISTING_CATEGORY}' as category, assessment_id, assessment_name, assessment_url,
      remote_testing, adaptive_irt, array_to_string({CODES}, '|') as test_type_codes,
      case when has_detail then description end as description,
      case when has_detail then assessment_length end as assessment_length,
      case when has_detail then {DURATION} end as duration_minutes,
      {TYPES_JOINED} as test_types,
      case when has_detail then concat(level, '|', p_brand) else '' end as job_levels,
      case when has_detail and lang_has_p then concat_ws('|', 'English (USA)', language2) else '' end as languages,
      remote_testing = 'Yes' as remote_testing_bool, adaptive_irt = 'Yes' as adaptive_irt_bool
    from src)"""
LINKS = """lk as (select page_id, unnest(h) as href, unnest(range(1, len(h) + 1)) as pos
       from (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) as h from pages))"""

SQL = {
    "pages_scan": "select page_id, url, length(html) as html_chars from pages",
    "page_files_links": f"with {LINKS} select page_id, pos, href from lk",
    "page_files_stream": "select page_id, url, length(html) as html_chars from pages",
    "catalog_quarantine": """select case p_partkey % 11 when 3 then 'missing assessment_name' when 5 then 'malformed' when 7 then 'malformed' else 'good' end as reason,
        count(*) as n, sum(case when p_partkey % 11 in (3, 5, 7) then 0 else p_partkey end) as sum_idx from part group by 1""",
    "page_links": f"with {LINKS} select page_id, pos, href from lk",
    "resolve_url": f"""with {LINKS},
        b as (select page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) as origin,
                     regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^([^#]*)', 1) as whole from pages),
        d as (select *, regexp_replace(path, '[^/]*$', '') as folder from b),
        u as (select *, case when folder = '/' then '/' else regexp_replace(folder, '[^/]+/$', '') end as upper from d)
        select lk.page_id, lk.pos, concat(u.origin, lk.href) as url from lk join u using (page_id)
        union all select page_id, -1, concat(whole, '#top') from u
        union all select page_id, -2, concat(origin, path, '?q=1') from u
        union all select page_id, -3, concat(origin, upper, 'up') from u
        union all select page_id, -4, concat(origin, folder, 'y/') from u
        union all select page_id, -5, concat(origin, upper) from u
        union all select page_id, -6, concat(origin, folder, 'a/b') from u
        union all select page_id, -7, concat(origin, '/r/t?u=../v') from u
        union all select page_id, -8, url from u""",
    "extract_listing": f"""with {SQL_SOURCE}
        select pg as page_id, cast(row_number() over (partition by pg order by catalog_idx) - 1 as integer) as row_pos,
               '{S.LISTING_CATEGORY}' as category, assessment_id, assessment_name, assessment_url,
               remote_testing, adaptive_irt, array_to_string({CODES}, '|') as test_type_codes from src""",
    "extract_details": f"""with {SQL_SOURCE}
        select assessment_url, description, rtrim(job_levels) as job_levels, case when lang_has_p then languages end as languages,
               assessment_length from src where has_detail""",
    "pages_stream_dedupe": f"""with {SQL_SOURCE}
        select assessment_id, pg * 12 + 1 as start,
               cast(row_number() over (partition by pg order by catalog_idx) - 1 as integer) as row_pos from src""",
    "pages_stream_until_repeat": f"""with {SQL_SOURCE}
        select assessment_id, pg * 12 + 1 as start,
               cast(row_number() over (partition by pg order by catalog_idx) - 1 as integer) as row_pos from src""",
    "pages_until_repeat": f"""with {SQL_SOURCE}
        select assessment_id, pg * 12 + 1 as start,
               cast(row_number() over (partition by pg order by catalog_idx) - 1 as integer) as row_pos from src""",
    "enrich_left_join": f"""with {SQL_SOURCE}
        select assessment_id, assessment_url, case when has_detail then description end as description,
               case when has_detail then rtrim(job_levels) end as job_levels,
               case when has_detail and lang_has_p then languages end as languages,
               case when has_detail then assessment_length end as assessment_length from src""",
    "catalog_build": f"with {TYPED} select * from typed",
    "catalog_json_roundtrip": f"with {TYPED} select * from typed",
    "clean_text": f"""with {SQL_SOURCE}
        select concat_ws('-', conv_id, turn) as key, {sql_strip('text')} as clean from conversations
        union all select assessment_id as key, description as clean from src""",
    "parse_duration": f"""with {SQL_SOURCE}
        select assessment_id as key, {DURATION} as minutes from src
        union all select concat('doc-', cast(doc_id as varchar)) as key,
               try_cast(translate(nullif(regexp_extract(text, '(\\p{{Nd}}+)', 1), ''), '{ND_SRC}', '{ND_DST}') as integer)
                 as minutes from documents""",
    "map_test_types": f"with {SQL_SOURCE} select catalog_idx, {TYPES_JOINED} as test_types from src",
    "split_list": f"""with {SQL_SOURCE}
        select catalog_idx, concat(level, '|', p_brand) as job_levels,
               case when language2 is null then 1 else 2 end as n_languages from src""",
    "yes_no": f"""with {SQL_SOURCE}
        select catalog_idx, remote_testing = 'Yes' as remote,
               case catalog_idx % 4 when 0 then remote_testing = 'Yes' when 1 then adaptive_irt = 'Yes'
                    when 2 then false else null end as mixed from src""",
    "url_slug": f"""with {SQL_SOURCE},
        v as (select assessment_id, case catalog_idx % 3 when 0 then assessment_url
                when 1 then concat(upper(assessment_url), '//')
                else replace(assessment_url, '{BASE_URL}/', '{BASE_URL}/solutions/') end as u from src)
        select assessment_id as key, lower(regexp_replace(string_split(u, 'view/')[-1], '/+$', '')) as slug from v
        union all select concat('page-', cast(page_id as varchar)) as key,
               lower(regexp_replace(string_split(url, 'view/')[-1], '/+$', '')) as slug from pages""",
    "embedding_text": f"""with {TYPED}
        select catalog_idx, concat_ws(' ', nullif(assessment_name, ''), nullif(description, ''),
               nullif(replace(test_types, '|', ' '), ''), nullif(replace(job_levels, '|', ' '), '')) as text from typed""",
    "bm25_text": f"""with {TYPED}
        select catalog_idx,
               concat_ws(' ', nullif(assessment_name, ''), nullif(description, ''), nullif(replace(test_types, '|', ' '), ''),
                         case when duration_minutes is not null then concat(cast(duration_minutes as varchar), ' minutes') end) as "full",
               concat_ws(' ', nullif(assessment_name, ''), nullif(description, '')) as name_desc,
               concat_ws(' ', nullif(assessment_name, ''), nullif(description, ''), nullif(replace(test_types, '|', ' '), '')) as name_desc_types
        from typed""",
}
SQL |= {
    "catalog_table_roundtrip": SQL["catalog_build"],
    "catalog_json_array": SQL["catalog_build"],
    "enrich_duplicate_details": SQL["enrich_left_join"],
    "revive_list_text": SQL["map_test_types"],
    "vectors_roundtrip": """select vec_id as catalog_idx, cast(i as integer) as i, round(cast(cast(embedding[i + 1] as float) as double), 6) as x
        from (select vec_id, embedding, unnest(range(len(embedding))) as i from embeddings)""",
    "nan_safe_int": """select p_partkey, case when p_partkey % 5 = 0 or p_partkey % 7 = 0 then null else cast(p_size as integer) end as minutes
        from part""",
}
