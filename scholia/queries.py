"""Registered queries of the engine's own operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as T
from .functions import llm_json as J
from .functions import unicode as U
from .functions.batches import bound_batches
from .operators import assemble, chapters, chunking, dedup, generation, headings, images, markdown, matching, outline, syllabus
from .plans.study import flagship
from .sources import output, state

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dedup_exact(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    return dedup.dedup_exact(docs, "text", "source", "doc_id").select("doc_id", "source", "lang", "content_hash", "first_ord", "n_copies")


def dedup_by_language(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedup_exact(spark, sf)
    return kept.groupBy("lang").agg(F.count("*").alias("n_kept"), F.sum(F.col("n_copies") - 1).alias("n_removed"))


def dedup_near_pairs_bound(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"))
    return dedup.length_bound_pairs(docs, "n", "doc_id", 0.92)


def dedup_near(spark: SparkSession, sf: str) -> DataFrame:
    from .plans.storage import Store

    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "text", F.col("source").alias("path"))
    return dedup.deduplicate(docs, "text", "path", "ord", Store(spark)).select("ord", F.length("text").cast("long").alias("n_chars"))


def normalize_metrics(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", U.normalize_text(F.col("text")).alias("clean"))
    return docs.select(
        "doc_id", F.length("clean").cast("long").alias("char_count"), T.n_words(F.col("clean")).alias("word_count"),
        T.n_lines(F.col("clean")).alias("line_count"), T.token_count(F.col("clean")).alias("token_count"))


def pdf_garbage_flag(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.is_pdf_garbage(F.col("html")).alias("garbage"))


def doc_type_syllabus(spark: SparkSession, sf: str) -> DataFrame:
    url = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf, "pages").select("page_id", T.file_type(url).alias("file_type"), T.is_syllabus(url).alias("is_syllabus"))


def paragraphs_sentences(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.size(T.paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"), F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return flagship(spark, table(spark, sf, "documents"))


def _topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("name"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id").cast("string").alias("document_id"), F.col("text").alias("content"))


def keyword_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return matching.chunks_by_keyword(_topics(spark, sf), _chunks(spark, sf))


def _document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("doc_id").cast("string")
    return table(spark, sf, "documents").select(F.concat(name, F.lit("/0")).alias("id"), name.alias("document_id"), F.col("text").alias("content"))


def keyword_chunks_documents(spark: SparkSession, sf: str) -> DataFrame:
    return matching.chunks_by_keyword(_topics(spark, sf), _document_chunks(spark, sf))


def _tiered(topics: DataFrame, chunks: DataFrame) -> DataFrame:
    by_turn = F.array(F.concat_ws("/", F.col("ord").cast("string"), F.lit("0")))
    listed = F.when(F.col("ord") % 3 == 0, by_turn).otherwise(F.array().cast("array<string>"))
    related = F.when(F.col("ord") % 3 == 1, F.array(F.col("ord").cast("string"))).otherwise(F.array().cast("array<string>"))
    topics = topics.withColumns({"chunk_ids": listed, "related_documents": related})
    return matching.chunks_for_topics(topics, chunks).select("ord", "id", "tier")


def tiered_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _tiered(_topics(spark, sf), _chunks(spark, sf))


def tiered_chunks_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _tiered(_topics(spark, sf), _document_chunks(spark, sf))


def best_match_entry(spark: SparkSession, sf: str) -> DataFrame:
    topics = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.concat("n_name", F.lit(" region")).alias("name"))
    entries = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("idx"), F.concat(F.lit("region "), "r_name").alias("title"))
    return matching.match_entries(topics, entries)


def entry_match_in_turn(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of parts as topics; their words in other orders, and shorter and longer forms, as entries."""
    kinds = table(spark, sf, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("key"))
    name, kind = F.col("p_name"), F.lower("p_type")
    topics = kinds.select(F.col("key").alias("ord"), F.concat_ws(" ", name, kind).alias("name"))
    forms = F.when(F.col("key") % 4 == 0, F.concat_ws(" ", kind, name)).when(F.col("key") % 4 == 1, F.substring_index(name, " ", 1)).when(
        F.col("key") % 4 == 2, F.concat_ws(" ", name, kind, F.lit("basics"))).otherwise(F.concat(F.substring_index(name, " ", -1), F.lit("-"), kind))
    return matching.match_entries(topics, kinds.select(F.col("key").alias("idx"), forms.alias("title")))


def prompt_material(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", F.col("doc_id").alias("ord"), F.col("text").alias("content"))
    return assemble.material_rows(docs, "source", 20_000, 3).select("source", F.col("ord").alias("doc_id"), F.length("part").cast("long").alias("n_chars"), F.md5("part").alias("part_md5"))


def chapter_topic_overlap(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    topics = parts.groupBy("p_type").agg(F.min("p_partkey").alias("ord")).select("ord", F.col("p_type").alias("name"), F.lit("").alias("description"))
    chapters = parts.groupBy("p_name").agg(F.min("p_partkey").alias("idx")).orderBy("idx").select(
        "idx", F.col("p_name").alias("title"), F.array().cast("array<string>").alias("sections"))
    return matching.chapter_topics(chapters, topics).select("idx", "ord", F.col("common").cast("long").alias("common"))


def _ranked_images(spark: SparkSession, sf: str, topics: DataFrame) -> DataFrame:
    topics = topics.withColumn("description", F.lit(""))
    images = table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.col("page_id").alias("ord"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("caption"), F.lit("").alias("file_path"))
    return matching.images_for_topics(topics, images).select("ord", "id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


def image_rank_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked_images(spark, sf, _topics(spark, sf))


def first_wins_distinct(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").withColumn("ord", F.col("conv_id") * 10000 + F.col("turn"))
    return dedup.first_wins(turns, [F.lower(F.trim("text"))], "ord").select("conv_id", "turn", "role")


def anchors_unique(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_type")
    return syllabus.unique_anchors(parts, T.ascii_slug(F.col("p_type")), "p_partkey").select("p_partkey", "anchor")


def language_ratio(spark: SparkSession, sf: str) -> DataFrame:
    ratio = markdown.language_ratio(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(ratio, F.lit(-1.0)).alias("ratio"))


def sentence_overlap_dups(spark: SparkSession, sf: str) -> DataFrame:
    return markdown.sentence_overlaps(table(spark, sf, "documents"), "doc_id", "text")


def _manuals(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as Markdown: each turn is a section."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("## "), "role", F.lit("\n"), "text").alias("part"))
    rows = F.sort_array(F.collect_list(F.struct("turn", "part")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["part"]), "\n").alias("md"))


def split_sections(spark: SparkSession, sf: str) -> DataFrame:
    found = markdown.sections(_manuals(spark, sf), "conv_id", "md")
    return found.select("conv_id", F.col("section").cast("long").alias("section"), "title", F.length("body").cast("long").alias("n_body"))


def order_violations(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("placed"))
    return markdown.order_violations(orders, "o_orderkey", "placed", ["o_custkey"]).select("o_custkey", "o_orderkey", "placed", "previous")


def budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", "doc_id", "text")
    return assemble.budget_prefix(docs, ["source"], "doc_id", F.length("text"), 20_000).select(
        "source", "doc_id", F.col("running").cast("long").alias("running"), F.col("taken").cast("long").alias("taken"))


def validation_rollup(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 0, "warning").otherwise("pass")
    return markdown.rollup(table(spark, sf, "labels").select(status.alias("status")))


def incremental_state(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_path"), T.sha256(F.col("text")).alias("content_hash"), "doc_id")
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash"))
    old = docs.where("doc_id % 5 <> 0").select("source_path", changed.alias("content_hash"), F.lit(1).alias("updated_at"))
    from .sources.files import classify

    return classify(docs, old).select("source_path", "change")


def cache_probe(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("model"), F.col("text").alias("prompt"))
    cache = turns.where("turn % 2 = 0").select(state.cache_key().alias("key"), F.length("prompt").cast("string").alias("response")).distinct()
    return state.probe(turns, cache).select("conv_id", "turn", "key", "response")


def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("model"), F.col("text").alias("prompt"))
    cache = turns.where("turn % 2 = 0").select(state.cache_key().alias("key"))
    return state.misses(turns, cache).groupBy("model").agg(F.count("*").alias("n_misses"))


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(
        "user_id", "event_type", F.col("event_id").alias("updated_at"), F.col("event_id").alias("created_at"))
    return state.upsert(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), "user_id")


def latest_hashes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("source").alias("source_path"), T.sha256(F.col("text")).alias("content_hash"), F.col("doc_id").alias("updated_at"))
    return state.latest_hashes(docs)


def toc_render(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation")
    rows = nations.select("n_regionkey", F.col("n_name").alias("title"), T.ascii_slug(F.col("n_name")).alias("anchor"), (F.col("n_nationkey") % 2 + 1).cast("int").alias("level"), F.col("n_nationkey").alias("ord"))
    return syllabus.render_toc(rows, "n_regionkey")


def _sources_block(spark: SparkSession, sf: str, orders: DataFrame) -> DataFrame:
    lines = orders.select(F.col("o_custkey").cast("string").alias("document_id"), F.col("o_orderkey").alias("ord"))
    docs = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("source_path"), (F.col("c_custkey") % 10 == 0).alias("is_syllabus"))
    return assemble.sources_block(lines, docs)


def sources_block(spark: SparkSession, sf: str) -> DataFrame:
    return _sources_block(spark, sf, table(spark, sf, "orders"))


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """Props as a model would answer them, in a fence and with escapes that JSON does not know."""
    given = F.concat(F.lit("```json\n"), F.replace(F.col("props"), F.lit("{"), F.lit('{"tex": "\\\\sum \\q", ')), F.lit("\n```"))
    read = J.parse_json(given, "struct<tex:string>")
    return table(spark, sf, "events").select("event_id", read["tex"].alias("tex"))


def image_refs_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Linked targets of pages as image references, against the words of the benchmark as files."""
    pages = table(spark, sf, "pages").select(F.regexp_replace("html", r'href="/([^"]*)"', "![x]($1)").alias("md"))
    words = table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("target")).distinct()
    return markdown.image_references(pages, "md").join(words, "target", "left_anti")


def plain_text_metrics(spark: SparkSession, sf: str) -> DataFrame:
    md = F.concat(F.lit("# Turn\n- ![i](x.png) **"), "role", F.lit("** [link](http://u)\n\n"), "text")
    plain = T.plain_text(md)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.size(T.keywords(plain)).cast("long").alias("n_keywords"), F.size(T.body_lines(F.col("text"))).cast("long").alias("n_body"),
        F.md5(plain).alias("plain_md5"))


def latest_document(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("source", "doc_id", "lang")
    return state.upsert(docs, docs.limit(0), "source", "doc_id", created=None)


def pdf_structure_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with PDF structure put between their lines, cleaned of it."""
    marks = F.lit(" a 1 0 obj\n<< /Type /Page >> x\nkeep stream words\nstream\n12 34 word\nnot 12 34 word\nTRAILER end\n/Width 5\n/Widths 5\n")
    docs = table(spark, sf, "documents").select("doc_id", F.concat(marks, F.regexp_replace("text", "[^\\x20-\\x7e\n]", "")).alias("t"))
    return docs.select("doc_id", F.md5(T.normalize_lines(F.col("t"))).alias("clean_md5"))


FOCUS = "Software License: Permission of the Notice"


def topic_focus(spark: SparkSession, sf: str) -> DataFrame:
    share = markdown.focus_share(F.col("text"), FOCUS)
    return table(spark, sf, "documents").select("doc_id", share.alias("share"), (share < markdown.FOCUS_RATIO).alias("rare"))


def heading_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters by type of part: headings that drift from the outline, put back."""
    kinds = table(spark, sf, "part").select(F.col("p_type").alias("title")).distinct()
    md = F.concat(F.lit("# x\n## "), "title", F.lit("\n## The Polished STEEL of it\n## Notes\n## Conclusion on brushed copper\ntext"))
    sections = F.array(F.lit("Polished steel"), F.lit("Brushed copper"))
    return kinds.select("title", headings.align_headings(md, F.col("title"), sections).alias("md"))


def decorative_headings(spark: SparkSession, sf: str) -> DataFrame:
    words = ["Notes", "References & Resources", "Appendix", "Recap", "Indice", "Notes on networks", "12", "ℹ More", "Key tips"]
    rows = table(spark, sf, "region").select("r_regionkey", F.explode(F.array(*map(F.lit, words))).alias("heading"))
    return rows.select("r_regionkey", "heading", headings.decorative("heading").alias("decorative"))


def claimed_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of parts as chapters that claim the coarser kinds, whose words they share."""
    parts = table(spark, sf, "part")
    mine = parts.select("p_type").distinct().select(F.concat("p_type", F.lit(" alloy and the chapter")).alias("title"))
    chapters_ = mine.select((F.rank().over(W.orderBy("title")) - 1).alias("idx"), "title")
    topics = chapters_.select(F.col("idx").alias("ord"), F.concat(F.lit("The "), F.regexp_replace("title", " and the chapter", ""), F.lit(" in use")).alias("name"))
    return syllabus.claim_topics(chapters_, topics)


def _nation_chapters(spark: SparkSession, sf: str) -> DataFrame:
    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("idx"), F.concat(F.upper(F.substring("r_name", 1, 1)), F.lower(F.substring("r_name", 2, 99))).alias("title"))
    names = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("sections"))
    return regions.join(names, F.col("idx") == F.col("n_regionkey")).select("idx", "title", "sections")


def _nation_topics(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        key.alias("ord"), F.col("n_name").alias("name"), F.concat(F.lit("About "), "n_name").alias("description"),
        F.array(F.col("n_regionkey").cast("string")).alias("related_documents"), (key % 4).alias("subtopic_count"), F.lit("syllabus").alias("order_source"),
        F.when(key % 3 > 0, 100 - key).alias("syllabus_position"), (key % 5 == 0).alias("missing_from_notes"), (key % 7 == 0).alias("extra_in_notes"))


def outline_chapters(spark: SparkSession, sf: str) -> DataFrame:
    one = F.lit("m").alias("manual")
    found = outline.chapters_with_topics(_nation_chapters(spark, sf).select(one, "*"), _nation_topics(spark, sf).select(one, "*"))
    return found.select("idx", "title", F.array_join(F.array_sort("topic_ords"), ",").alias("topics"))


def _as_syllabi(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as syllabi: their lines in turn take a form of chapter or section lines, by place and id."""
    turn = lambda i: F.pmod(i + F.col("doc_id"), F.lit(13))
    before = ("### Chapter ", "**module ", "", "  ", "1."), (": ", " - ", ". ", ") ", " ")
    around = (("    c) ", ""), ("- **", "**"), ("\t", ""), ("## IV. ", "**"), ("(b) ", ""), ("• ", ""), ("   ", " "), ("Uni 3 ", ""))

    def form(x, i):  # noqa: ANN001, ANN202
        lines = [F.concat(F.lit(a), i.cast("string"), F.lit(b), x) for a, b in zip(*before, strict=True)]
        lines += [F.concat(F.lit(a), x, F.lit(b)) for a, b in around]
        out = F.lit("")
        for n, line in enumerate(lines):
            out = F.when(turn(i) == n, line).otherwise(out)
        return F.when(F.pmod(i, F.lit(5)) == 4, F.concat(F.lit("\n"), out)).otherwise(out)

    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), form), "\n").alias("text"))


def syllabus_outline(spark: SparkSession, sf: str) -> DataFrame:
    found = syllabus.syllabus_structure(_as_syllabi(spark, sf), "doc_id", "text")
    return found.select(F.col("key").cast("long").alias("doc_id"), "idx", "title", F.array_join("sections", "|").alias("sections"))


def uncovered_topics(spark: SparkSession, sf: str) -> DataFrame:
    held = _nation_chapters(spark, sf).where("idx < 3").select(F.transform("sections", lambda s: F.length(s).cast("long")).alias("topic_ords"))
    return outline.uncovered(_nation_topics(spark, sf), held).select("ord", "name")


def closest_topics(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").groupBy("p_type").agg(F.min("p_partkey").alias("idx")).select("idx", F.col("p_type").alias("title"))
    topics = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord")).select("ord", F.col("p_name").alias("name"))
    return outline.closest_topics(parts, topics)


def outline_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as chapters over the nations' topics, without one of them and with all."""
    # A nation's name is one word here: an underline would part it.
    topics = _nation_topics(spark, sf).withColumn("name", F.translate("name", "_", "x"))
    chapters_ = _nation_chapters(spark, sf).withColumn("sections", F.transform("sections", lambda s: F.translate(s, "_", "x")))
    found = [outline.outline_warnings(c, topics).withColumn("outline", F.lit(n)) for n, c in (("cut", chapters_.where("idx <> 2")), ("whole", chapters_))]
    return found[0].unionByName(found[1]).withColumn("name", F.translate("name", "x", "_"))


def topic_order(spark: SparkSession, sf: str) -> DataFrame:
    return outline.topic_order(_nation_topics(spark, sf)).select("name", F.col("place").cast("long").alias("place"))


def topics_block(spark: SparkSession, sf: str) -> DataFrame:
    regions = table(spark, sf, "nation").select("n_regionkey", F.col("n_nationkey").alias("ord"))
    return outline.format_topics(_nation_topics(spark, sf).join(regions, "ord"), "n_regionkey")


def chunk_ids_by_name(spark: SparkSession, sf: str) -> DataFrame:
    answers = table(spark, sf, "events").select(
        F.col("event_id").alias("ord"), F.concat("event_type", (F.col("user_id") % 10).cast("string")).alias("name"),
        F.when(F.col("event_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("user_id").cast("string"))).alias("chunk_ids"))
    return outline.chunk_ids_by_name(answers).select("name", F.col("chunk_ids")[0].alias("chunk_id"))


def focus_subtopics(spark: SparkSession, sf: str) -> DataFrame:
    return outline.focus_topic("software", table(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("software")))).select("name", "subtopic_count")


def topic_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return outline.coverage(_nation_topics(spark, sf))


def chapter_selection(spark: SparkSession, sf: str) -> DataFrame:
    picked = outline.selected_chapters("2, 4,x,4, 99,-1,0", 5)
    return _nation_chapters(spark, sf).where(F.col("idx").isin(picked)).select("idx", "title")


def record_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 6 > 0, F.col("s_name")).alias("name"), F.floor("s_acctbal").alias("width"))
    return outline.violations(rows, ["name"], {"width": 0}).select("s_suppkey", F.array_join("errors", "; ").alias("errors"))


def normalized_documents(spark: SparkSession, sf: str) -> DataFrame:
    raws = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 9 > 0, F.regexp_replace("url", "/", " \t /")).alias("content"))
    good, bad = outline.normalized_documents(raws)
    return good.select("id", "char_count", "word_count", "line_count").unionByName(bad.select("id"), allowMissingColumns=True).fillna(-1)


def inventory_json(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("ord"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"),
        F.lower("n_name").alias("source_path"), F.lit("pdf").alias("file_type"), (F.col("n_nationkey") % 4 == 3).alias("is_syllabus"))
    return output.inventory(docs)


def topics_json(spark: SparkSession, sf: str) -> DataFrame:
    return output.topics_file(_nation_topics(spark, sf))


def outline_md(spark: SparkSession, sf: str) -> DataFrame:
    return output.outline_file(syllabus.index_entries(_nation_chapters(spark, sf)))


def index_checklist(spark: SparkSession, sf: str) -> DataFrame:
    return output.index_file(_nation_chapters(spark, sf), table(spark, sf, "region").select(F.col("r_regionkey").alias("idx")).where("idx % 2 = 0"))


def chapter_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select((F.col("c_custkey") - 1).alias("idx"), F.concat_ws(" - ", "c_name", "c_mktsegment").alias("title"), F.col("c_mktsegment").alias("md"))
    return output.chapter_files(rows)


def existing_chapters(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("o_orderkey") % 5 == 0, F.lit("cap_x_y.md")).when(F.col("o_orderkey") % 5 == 1, F.lit("notes.md")).otherwise(
        F.concat(F.lit("out/cap_"), F.col("o_custkey").cast("string"), F.lit("_a-b.md")))
    return output.existing_chapters(table(spark, sf, "orders").select(name.alias("path")), 100)


def chapters_to_generate(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "customer").select(F.col("c_custkey").cast("int").alias("idx"))
    return output.to_generate(asked, existing_chapters(spark, sf), None)


def validation_json(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.col("n_nationkey") % 6 == 5
    checks = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("ord"), F.col("n_name").alias("check"), F.when(bad, "warning").otherwise("pass").alias("status"),
        F.when(bad, F.array("n_name")).otherwise(F.array().cast("array<string>")).alias("errors"))
    return output.validation_file(checks)


def scan_counters(spark: SparkSession, sf: str) -> DataFrame:
    kinds = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("source_path"), T.file_type(F.regexp_replace("url", r"[?#].*$", "")).alias("file_type"))
    return output.scan_counters(incremental_state(spark, sf).join(kinds, "source_path"))


def syllabus_probe(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/n/"), F.when(F.col("n_nationkey") % 4 == 0, F.lit("sub/")).otherwise(""), F.lower("n_name"), F.lit(" syllabus.pdf"))
    files = table(spark, sf, "nation").select(path.alias("path")).select("path", T.file_type(F.col("path")).alias("file_type"), T.is_syllabus(F.col("path")).alias("is_syllabus"))
    return output.probe_syllabus(files, "/n")


def ocr_images(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, ("PNG", "jpeg", "gif", "pdf", "jpg"))), (F.col("n_regionkey") + 1).cast("int"))
    return table(spark, sf, "nation").select("n_nationkey", T.is_ocr_image(F.concat("n_name", F.lit("."), suffix)).alias("readable"))


def encoded_images(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.encode_image(F.col("text").cast("binary")).alias("encoded"))


def depth_budget(spark: SparkSession, sf: str) -> DataFrame:
    depth = F.col("n_nationkey") - 4
    return table(spark, sf, "nation").select(
        "n_nationkey", T.depth_tokens(depth).alias("tokens"), T.depth_band(depth).alias("band"),
        T.context_budget(F.repeat("n_name", 4000), T.depth_tokens(depth)).alias("context"))


def _processing_state(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        T.sha256(F.col("text")).alias("content_hash"), F.concat("source", F.lit("/"), (F.col("doc_id") % 50).cast("string")).alias("source_path"),
        F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("model"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id").cast("string")).alias("topics_json"),
        F.col("doc_id").alias("updated_at"))


def invalidated_state(spark: SparkSession, sf: str) -> DataFrame:
    rows = _processing_state(spark, sf)
    return state.invalidated(rows, "src0/7").agg(F.count("*").alias("n_gone")).join(state.invalidate(rows, "src0/7").agg(F.count("*").alias("n_left")))


def previous_models(spark: SparkSession, sf: str) -> DataFrame:
    return state.previous_models(_processing_state(spark, sf))


def latest_topics(spark: SparkSession, sf: str) -> DataFrame:
    return state.latest_topics(_processing_state(spark, sf))


def topics_update(spark: SparkSession, sf: str) -> DataFrame:
    return state.with_topics(_processing_state(spark, sf), "[]").groupBy("model", "topics_json").agg(F.count("*").alias("n"))


def state_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("content_hash"), "c_name")
    return state.lookup(rows, "content_hash", "h77")


def document_deletion(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return state.without(docs, "doc_id", 17).groupBy("lang").agg(F.count("*").alias("n"))


def cache_without_model(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("role").alias("model"), F.col("text").alias("prompt"))
    return state.without(turns, "model", "user").groupBy("model").agg(F.count("*").alias("n"))


def cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    rows = turns.groupBy("conv_id", "role").agg(F.min("turn").alias("a"), F.max("turn").alias("b"), F.min_by("text", "turn").alias("p"))
    row = lambda t, note: rows.select(
        F.concat_ws("/", F.col("conv_id").cast("string"), "role").alias("key"), F.concat(F.lit(note), F.substring("p", 1, 20)).alias("prompt_preview"),
        F.col(t).cast("string").alias("response"), F.col("role").alias("model"), F.col(t).alias("created_at"))
    return state.save_cache(row("a", "old "), row("b", "new ").where("created_at % 2 = 0"))


def reused_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of unchanged files from their state, round trip through JSON, then those of new files."""
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("content_hash"), F.col("turn").cast("int").alias("position"), F.col("role").alias("id"), F.col("text").alias("content"))
    known = state.chunks_to_json(turns.where("cast(content_hash AS long) % 2 = 0"), "content_hash")
    old, again = state.reused_chunks(turns.select("content_hash").distinct(), known)
    cached = state.chunks_from_json(old, "content_hash").select("content_hash", "position", F.md5("content").alias("content_md5"))
    new = turns.join(again, "content_hash").select("content_hash", "position", F.md5("content").alias("content_md5"))
    return state.all_chunks(cached, new)


def topic_images(spark: SparkSession, sf: str) -> DataFrame:
    candidates = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("source_document_id"))
    return chapters.images_of_topics(_nation_topics(spark, sf), candidates).groupBy("ord").agg(F.count("*").alias("n"))


def meaningful_content(spark: SparkSession, sf: str) -> DataFrame:
    md = F.concat(F.lit("# T\n> q\n---\n[Chunk 1]\n[...]\n"), F.regexp_replace("text", r"\. ", ".\n"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.has_meaningful_content(md).alias("meaningful"))


def invalid_names(spark: SparkSession, sf: str) -> DataFrame:
    given = F.element_at(F.array(*map(F.lit, ("Topic 3", " t12 ", "Untitled", "N/A", "", "x", "2024", "Topics 3", "no title", "Bayes"))), (F.col("n_nationkey") % 10 + 1).cast("int"))
    return table(spark, sf, "nation").select("n_nationkey", T.is_invalid_name(given).alias("invalid"))


def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


def chunk_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of short turns: one chunk each, the text itself, at place 0."""
    turns = table(spark, sf, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("content"))
    return chunking.create_chunks(turns, "id", "content").groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.max("position").cast("long").alias("last"))


def _as_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as Markdown: their lines in turn become titles, links, sections, quotes, fences, images and prose."""
    around = (("# ", ""), ("- [", "](#a)"), ("", ""), ("## ", ""), ("> ", ""), ("```", ""), ("  ### ", ""), ("", ""), ("### ", ""), ("---", None), ("![i](", ")"), ("[...]", None), ("  - [x](#", ")"))
    k = lambda i: F.pmod(i * (F.col("doc_id") % 3 + 1) + F.col("doc_id"), F.lit(13))

    def form(x, i):  # noqa: ANN001, ANN202
        out = x
        for n, (a, b) in enumerate(around):
            out = F.when(k(i) == n, F.lit(a) if b is None else F.concat(F.lit(a), x, F.lit(b))).otherwise(out)
        return out

    cut = F.transform(F.split("text", "\n"), lambda x: F.substring(F.regexp_replace(x, r"[^A-Za-z0-9 ]", ""), 1, 60))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.transform(cut, form), "\n").alias("md"))


def markdown_heads(spark: SparkSession, sf: str) -> DataFrame:
    md = F.col("md")
    return _as_markdown(spark, sf).select(
        "doc_id", T.title(md).alias("title"), F.array_join(T.headings(md), "|").alias("headings"), F.md5(assemble.without_local_toc(md)).alias("without_toc"),
        F.md5(T.image_paths(md)).alias("image_paths"), F.size(T.body_lines(md)).cast("long").alias("n_body"), F.md5(T.without_artifacts(md)).alias("clean"))


def structure_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _as_markdown(spark, sf).select("doc_id", F.array_join(markdown.structure_errors(F.col("md")), "|").alias("errors"))


def empty_and_hollow_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections without text, and those whose text is no content."""
    md = _as_markdown(spark, sf)
    empty = markdown.sections(md, "doc_id", "md").where(F.length("body") == 0)
    columns = ("doc_id", F.col("section").cast("long").alias("section"), "title")
    return empty.select(F.lit("empty").alias("kind"), *columns).unionByName(markdown.hollow_sections(md, "doc_id").select(F.lit("hollow").alias("kind"), *columns))


def toc_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Links of each text's first list, and whether a heading has that slug."""
    md = _as_markdown(spark, sf).withColumn("md", F.concat("md", F.lit("\n## a")))
    return markdown.checked_links(md, "doc_id").select("doc_id", F.col("at").cast("long").alias("at"), "anchor", "broken")


def syllabus_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _as_syllabi(spark, sf).select("doc_id", F.posexplode(syllabus.entries(F.col("text"))).alias("at", "entry")).select("doc_id", F.col("at").cast("long").alias("at"), "entry")


def syllabus_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of parts as entries and names as topics, turns as notes: matched topics, entries without one, extras."""
    parts = table(spark, sf, "part")
    topics = parts.where("p_partkey % 3 > 0").groupBy("p_name").agg(F.min("p_partkey").alias("ord")).select("ord", F.col("p_name").alias("name"), F.array(F.lit("d")).alias("related_documents"))
    entries = table(spark, sf, "benchmark").select(F.col("item_id").cast("int").alias("idx"), F.concat(F.substring_index("text", " ", 2), F.when(F.col("item_id") % 4 == 0, F.lit(" red widget")).otherwise("")).alias("title"))
    found = matching.covered_syllabus(topics, entries, _chunks(spark, sf))
    return found.select(F.col("ord").cast("long").alias("ord"), "name", F.coalesce("syllabus_position", F.lit(-1)).cast("long").alias("syllabus_position"), "missing_from_notes", "extra_in_notes",
                        F.when(~F.col("extra_in_notes") & (F.col("ord") == F.col("syllabus_position")), F.size("related_documents")).otherwise(1).cast("long").alias("n_documents"))


def chapters_by_syllabus(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as chapters in the order of their topics' positions, those without one behind."""
    topics = _nation_topics(spark, sf)
    chapters_ = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.initcap("n_name").alias("title"))
    numbered = assemble.numbered(F.concat(F.lit("intro\n# "), F.col("title"), F.lit("\n# x")), F.col("place"))
    return assemble.sort_by_syllabus(chapters_, topics).select("ord", F.col("place").cast("long").alias("place"), numbered.alias("md"))


def cut_json(spark: SparkSession, sf: str) -> DataFrame:
    """Outlines whose JSON ends too early, and outlines written as Markdown, as lists of chapters."""
    text = table(spark, sf, "documents").select("doc_id", F.transform(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0), lambda x: F.regexp_replace(x, "[^A-Za-z ]", "")).alias("ls"))
    named = text.select("doc_id", F.filter("ls", lambda x: F.length(F.trim(x)) > 0).alias("ls")).where("size(ls) > 1")
    as_json = F.concat(F.lit('{"chapters": ['), F.array_join(F.transform("ls", lambda x: F.concat(F.lit('{"title": "'), F.trim(x), F.lit('", "sections": ["s"]}'))), ", "), F.lit(', {"title": "cut'))
    as_md = F.array_join(F.transform("ls", lambda x, i: F.concat(F.lit("## Chapter "), (i + 1).cast("string"), F.lit(": "), F.trim(x), F.lit("\n- s\n2. t"))), "\n")
    asked = named.select("doc_id", F.when(F.col("doc_id") % 2 == 0, as_json).otherwise(as_md).alias("response"))
    return generation.parse_outline(asked, "doc_id").select("doc_id", F.col("idx").cast("long").alias("idx"), "title", F.array_join("sections", "|").alias("sections"))


def parsed_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts as a model's lists of topics: repeated names once, names that name nothing by number."""
    rows = table(spark, sf, "part").withColumn("name", F.when(F.col("p_partkey") % 9 == 0, F.lit(" Topic 3 ")).when(F.col("p_partkey") % 11 == 0, F.lit("N/A")).otherwise(F.col("p_name")))
    listed = F.sort_array(F.collect_list(F.struct("p_partkey", F.struct("name", F.col("p_brand").alias("description"), (F.col("p_size") - 20).alias("subtopic_count")).alias("t"))))
    asked = rows.groupBy("p_type").agg(F.to_json(F.struct(F.transform(listed, lambda x: x["t"]).alias("topics"))).alias("response"))
    return generation.parse_topics(asked, "p_type").select("p_type", F.col("ord").cast("long").alias("ord"), "name", "description", F.col("subtopic_count").cast("long").alias("subtopic_count"))


def vision_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as images of their conversations: described ones first, up to the cap; of the relevant ones the first."""
    turns = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ord"), F.when(F.length("text") % 3 == 0, F.col("text")).alias("ai_description"), (F.length("text") % 2 == 0).alias("relevant"))
    few = images.vision_candidates(turns, "conv_id", 4)
    kept = images.accepted(few, "conv_id", 2).select("conv_id", "ord", F.col("place").cast("long").alias("place"))
    return few.join(kept, ["conv_id", "ord"], "left").select("conv_id", "ord", F.col("rank").cast("long").alias("rank"), F.coalesce("place", F.lit(0)).cast("long").alias("place"))


def heading_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(U.heading_key(F.concat(F.lit("12. "), F.regexp_replace("text", "[^\\x00-\\x7F]", "")))).alias("key_md5"), F.regexp_replace(F.substring("text", 1, 200), "\n", " ").alias("preview"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        dedup_exact, dedup_by_language, dedup_near_pairs_bound, dedup_near, normalize_metrics, pdf_garbage_flag, doc_type_syllabus,
        paragraphs_sentences, chunks, keyword_chunks, tiered_chunks, best_match_entry, entry_match_in_turn, prompt_material, chapter_topic_overlap, image_rank_topk,
        first_wins_distinct, anchors_unique, language_ratio, sentence_overlap_dups, split_sections, order_violations, budget_prefix,
        validation_rollup, incremental_state, cache_probe, cache_misses, upsert_latest, latest_hashes, toc_render, sources_block,
        keyword_chunks_documents, tiered_chunks_documents,
        json_props, image_refs_antijoin, plain_text_metrics, latest_document, pdf_structure_lines, topic_focus, heading_alignment, decorative_headings,
        claimed_topics, outline_chapters, syllabus_outline, uncovered_topics, closest_topics, outline_warnings, topic_order, topics_block, chunk_ids_by_name, focus_subtopics,
        topic_coverage, chapter_selection, record_violations, normalized_documents, inventory_json, topics_json, outline_md, index_checklist, chapter_files,
        existing_chapters, chapters_to_generate, validation_json, scan_counters, syllabus_probe, ocr_images, encoded_images, depth_budget, invalidated_state,
        previous_models, latest_topics, topics_update, state_lookup, document_deletion, cache_without_model, cache_upsert, reused_chunks, topic_images,
        meaningful_content, invalid_names, token_estimate, chunk_positions, markdown_heads, structure_errors, empty_and_hollow_sections, toc_anchors, syllabus_entries,
        syllabus_coverage, chapters_by_syllabus, cut_json, parsed_topics, vision_candidates, heading_keys,
    )
}
