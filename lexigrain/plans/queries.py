"""The registered queries of the library, and their SQL.

``documents`` has no headings, so queries over it cut texts directly;
``conversations`` becomes markdown whose headings make every rule fire.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigrain.functions import text as fn
from lexigrain.functions.stem import stem_column
from lexigrain.operators import fulltext, vector
from lexigrain.operators.chunks import chunk_documents, greedy_pack, split_to_budget
from lexigrain.operators.classify import ConstantClassifier, ModelClassifier, RuleClassifier, forecast_cost
from lexigrain.operators.embed import LocalServiceEmbedder, hash_embedding
from lexigrain.operators.interchange import from_flat, to_flat
from lexigrain.operators.store import ChunkStore
from lexigrain.plans.ingest import assemble, ingest_documents
from lexigrain.schema import CHUNK_SCHEMA, DEFAULT_CONTENT_TYPES, ChunkingConfig, Source
from lexigrain.sources.extract import CachedPages, FormFeedText, GivenPages
from lexigrain.sources.files import read_texts, write_texts
from lexigrain.storage import new_path

SOURCE = Source("corpus", "Corpus", "generic", "", "hash-16", 16, "homebrew", ChunkingConfig(min_tokens=40, max_tokens=120, overlap_tokens=10))
#: Chunking of pages.
PAGED = ChunkingConfig(min_tokens=25, max_tokens=70, overlap_tokens=5, overflow="sentence")
#: Every row whose id is divisible by this is a query of the searches.
QUERY_EVERY = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a conversation as one document, a heading and a body for each turn."""
    t = table(spark, sf_dir, "conversations")
    kind = F.col("turn") % 6
    title = F.when(kind == 0, "Random tables").when(kind == 1, "Bestiary").when(kind == 2, "The World").when(kind == 3, "Running the game").when(kind == 4, "Moves").otherwise("Talk")
    lead = F.when(kind == 1, "HP 3\n").when(kind == 4, "**When you speak**, roll.\n").otherwise("")
    level = F.repeat(F.lit("#"), 4 - F.col("turn").cast("int") % 3)
    part = F.concat(level, F.lit(" "), title, F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), lead, F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", part.alias("part"))))
    body = F.array_join(F.transform(ordered, lambda x: x.part), "\n")
    return t.groupBy("conv_id").agg(body.alias("body")).select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("doc_id"), F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n"), F.col("body")).alias("text"))


def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of every conversation, classified and hashed."""
    out = RuleClassifier().apply(chunk_documents(conversations_markdown(spark, sf_dir), SOURCE.chunking))
    return out.select("doc_id", "chunk_order", F.array_join("heading_path", " > ").alias("headings"), fn.token_count("text").alias("token_count"), fn.content_hash("text").alias("content_hash"), F.sha2("text", 256).alias("text_sha256"), "content_type", "move_trigger", "npc_name")


def content_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct chunks by content type: the flagship, from text to counts."""
    rows = conversation_chunks(spark, sf_dir)
    first = Window.partitionBy("doc_id", "content_hash").orderBy("chunk_order")
    kept = rows.withColumn("n", F.row_number().over(first)).filter("n = 1")
    return kept.groupBy("content_type").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fn.token_count("text").alias("tokens"))


def normalized_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fn.content_hash("text").alias("content_hash"), F.length(fn.normalize_text("text")).alias("n"))


def token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.transform(fn.ws_tokens("text"), lambda w: w)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("word")).groupBy("doc_id").agg(F.count_distinct("word").alias("distinct_words"), F.max("word").alias("last_word"))


def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed to 60 tokens, without the ladder."""
    pieces = greedy_pack(F.col("text"), rf"(?<=[.!?]){fn.WS}+", 60)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pieces).alias("piece", "text")).select("doc_id", "piece", F.sha2("text", 256).alias("text_sha256"))


def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without line breaks cut into windows of 50 tokens, overlapping by 5; what fits stays as it is."""
    one_line = F.translate("text", "\n|", "  ")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split_to_budget(one_line, 50, 5, "token")).alias("piece", "text")).select("doc_id", "piece", F.sha2("text", 256).alias("text_sha256"))


def budget_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ladder, from paragraphs down, with tables kept whole."""
    text = F.concat(F.regexp_replace("text", "\n", "\n\n"), F.lit("\n| a | b |\n|---|---|\n| 1 | 2 |"))
    cut = split_to_budget(text, 80, 10)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(cut).alias("piece", "text")).select("doc_id", "piece", fn.token_count("text").alias("tokens"), F.sha2("text", 256).alias("text_sha256"))


def page_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page markers put in, found again and taken out."""
    marked = fn.inject_page_marker(F.col("text"), F.col("doc_id"))
    t = table(spark, sf_dir, "documents").select("doc_id", "text", marked.alias("marked"))
    return t.select("doc_id", fn.page_of("marked").alias("page"), F.length("marked").alias("n_marked"), (fn.without_markers("marked") == fn.strip("text")).alias("same"))


def form_feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pages: blank ones leave gaps in the numbers."""
    pages = fn.split_pages(F.translate("text", "\n", "\f"))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(pages)).groupBy("doc_id").agg(F.count("*").alias("pages"), F.max("page_num").alias("last_page"), F.sum(F.length("text")).alias("chars"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of documents as text files of one line a page; every third page begins with a heading."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    page = lambda x, i: F.when(i % 3 == 1, F.concat(F.repeat(F.lit("#"), i % 4 + 1), F.lit(" Page\n"), x)).otherwise(x)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.array_join(F.transform(lines, page), "\f"), "UTF-8").alias("content"))


def paged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of pages: extracted, joined with markers, chunked, and every chunk's page found again."""
    pages = FormFeedText().pages(document_pages(spark, sf_dir))
    joined = pages.groupBy("path").agg(fn.join_pages(F.array_sort(F.collect_list(F.struct("page_num", "text")))).alias("text"))
    out = chunk_documents(joined, PAGED, paged=True)
    return out.select("path", "chunk_order", F.array_join("heading_path", ">").alias("headings"), "page", F.sha2("text", 256).alias("text_sha256"))


def cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all documents out of a page cache that the first call has filled."""
    files = document_pages(spark, sf_dir)
    extractor = CachedPages(FormFeedText(), new_path(spark, "page-cache"))
    extractor.pages(files)
    return extractor.pages(files).select("path", "page_num", F.sha2("text", 256).alias("text_sha256"))


def single_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of every document that has one."""
    return FormFeedText().page(document_pages(spark, sf_dir), 2).select("path", "page_num", F.length("text").alias("n"))


def given_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two given pages for every document."""
    pages = GivenPages(((2, "second"), (1, "# First"))).pages(document_pages(spark, sf_dir))
    return pages.groupBy("page_num", "text").agg(F.count("*").alias("n"))


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files and read whole: characters and lines of all."""
    path = new_path(spark, "texts")
    write_texts(table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value")), path)
    files = read_texts(spark, path)
    return files.agg(F.sum(F.length("text")).alias("chars"), F.sum(F.length("text") - F.length(F.translate("text", "\n", ""))).cast("long").alias("lines"), (F.count("doc_path") == F.count_distinct("doc_path")).alias("own_paths"))


def heading_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over documents, with their source as heading and a table in every seventh."""
    path = F.array(F.concat(F.lit("Random "), "source"), F.when(F.col("doc_id") % 2 == 0, F.lit("World")).otherwise(F.lit("NPCs")))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\n | a | b |\n|c|"))).when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit("\n| a | b |"))).otherwise(F.col("text"))
    t = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.slice(path, F.when(F.col("doc_id") % 3 == 0, 1).otherwise(2), 2).alias("heading_path"))
    return RuleClassifier().apply(t).groupBy("content_type").agg(F.count("*").alias("n"), F.count("npc_name").alias("named"))


def _reply(system: str, prompt: str, max_tokens: int) -> str:
    """A stand-in for a language model: a type by each passage's last heading, an unknown one for source 3, remarks around."""
    kinds = ["mechanic" if h.endswith("1") else "song" if h.endswith("3") else "lore" for h in re.findall(r"(?m)^\[\d+\] heading: .* / (\S+)$", prompt)]
    items = [{"content_type": k, "tags": [k, 7] if k != "mechanic" else "none", "npc_name": "null", "scene_type": "[x]" if k == "song" else None} for k in kinds]
    return f"```json\n{json.dumps(items)}\n``` that is all]"


def model_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types by a language model behind an injected function, in batches."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.array(F.coalesce("lang", F.lit("-")), F.coalesce("source", F.lit("-"))).alias("heading_path"))
    out = ModelClassifier(_reply, DEFAULT_CONTENT_TYPES, batch_size=20).apply(t)
    return out.select("doc_id", "content_type", F.array_join("tags", ",").alias("tags"), "npc_name", "scene_type")


def _passages(system: str, prompt: str) -> int:
    return len(re.findall(r"(?m)^\[\d+\] heading: ", prompt))


def cost_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What classifying all documents would cost at fallback prices, a passage counting as one token."""
    t = table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text"), F.array("lang").alias("heading_path"))
    got = forecast_cost(ModelClassifier(_reply, DEFAULT_CONTENT_TYPES, count=_passages), t)
    return spark.createDataFrame([(got.n_chunks, got.input_tokens, got.output_tokens, round(got.total_cost_usd, 6))], "n_chunks long, input_tokens long, output_tokens long, cost double")


def _post(url: str, body: Mapping[str, object], headers: Mapping[str, str]) -> dict[str, object]:
    return {"embeddings": [[len(t), t.count("e"), -1] for t in body["input"]]}


def service_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings by a service behind an injected transport: length, letters e, and -1."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = LocalServiceEmbedder("m", 3, post=_post).apply(t, "text")
    return out.select("doc_id", *(F.get("embedding", F.lit(i)).cast("double").alias(f"v{i}") for i in range(3)))


def constant_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", "text", F.array("lang").alias("heading_path"))
    return ConstantClassifier("lore", ("x",)).apply(t).groupBy("content_type", F.array_join("tags", ",").alias("tags")).agg(F.count("*").alias("n"))


def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of every document's hash embedding."""
    v = hash_embedding(F.col("text"), 16)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(v).alias("i", "x")).select("doc_id", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


def cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest to the first vector of label 3 rows and all."""
    t = table(spark, sf_dir, "embeddings").withColumn("id", F.col("vec_id"))
    q = t.filter("vec_id = 0").select("embedding").first()
    got = vector.similarity_search(t, q.embedding if q else [0.0], 10)
    return got.select("vec_id", F.round("score", 5).alias("score"), "rank")


def cosine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by QUERY_EVERY, among all."""
    t = table(spark, sf_dir, "embeddings")
    got = vector.similarity_join(t.filter(F.col("vec_id") % QUERY_EVERY == 0).withColumn("query_id", F.col("vec_id")), t.withColumn("id", F.col("vec_id")), 5)
    return got.select("query_id", F.col("id").alias("vec_id"), F.round("score", 5).alias("score"), "rank")


def filtered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality filters on whitelisted columns."""
    t = table(spark, sf_dir, "documents").select(F.col("lang").alias("system"), F.col("source").alias("content_type"), "n_chars")
    return vector.apply_filters(t, {"system": "en", "content_type": "src0"}).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").filter(F.col("item_id") % QUERY_EVERY == 0)
    return items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lit("corpus").alias("source_id"), F.col("doc_id").cast("string").alias("id"), "text")


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for every benchmark item whose id is divisible by QUERY_EVERY, unstemmed, without stop words."""
    index = fulltext.build_index(_documents(spark, sf_dir), stemmed=False, stop_words=())
    return fulltext.bm25_join(_items(spark, sf_dir), index, 10).select(F.col("query_id").alias("item_id"), "id", F.round("score", 6).alias("score"), "rank")


def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with stems and stop words."""
    index = fulltext.build_index(_documents(spark, sf_dir))
    return fulltext.bm25_join(_items(spark, sf_dir), index, 10).select(F.col("query_id").alias("item_id"), "id", F.round("score", 6).alias("score"), "rank")


def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each source's index."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("id"), "text")
    index = fulltext.build_index(docs, stemmed=False, stop_words=())
    words = index.dictionary.groupBy("source_id").agg(F.count("*").alias("terms"), F.max("df").alias("most"))
    return index.statistics.join(words, "source_id").select("source_id", "n_docs", F.round("avgdl", 6).alias("avgdl"), "terms", "most")


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of the distinct words of all documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(fulltext.terms(F.col("text"))).alias("word")).distinct()
    return words.withColumn("stem", stem_column("word"))


#: A source of documents as chunks: a document of the source's name holds them all.
STORED = Source("docs", "Documents", "generic", "", "hash-4", 4, "homebrew")


def _chunk_rows(rows: DataFrame, **columns: Column | str) -> DataFrame:
    """``rows`` in the store's columns; what is not given is null."""
    given = {"source_id": F.lit(STORED.id), **columns}
    return rows.select(*((F.col(given[f.name]) if isinstance(given.get(f.name), str) else given.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in CHUNK_SCHEMA.fields))


def _as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    model = F.concat(F.lit("model-"), F.coalesce("lang", F.lit("-")))
    return _chunk_rows(table(spark, sf_dir, "documents"), id="doc_id", doc_id="source", text=text, embedding=hash_embedding(text, 4), embedding_model=model, content_hash=fn.content_hash(text), content_type="lang", chunk_order="doc_id")


def _store(spark: SparkSession, **how) -> ChunkStore:
    store = ChunkStore(spark, new_path(spark, "store"), **how)
    store.initialize(STORED)
    return store


def dedup_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store keeps of all documents: the first of each source and content hash."""
    store = _store(spark)
    n = store.insert(STORED, _as_chunks(spark, sf_dir))
    return store.chunks(STORED.id).groupBy("doc_id").agg(F.count("*").alias("kept"), F.min("chunk_order").alias("first_doc"), F.count_distinct("id").alias("ids")).withColumn("inserted", F.lit(n).cast("long"))


def known_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even ids inserted, then all, then all again: what came with the second insert, and how many each gave."""
    store, rows = _store(spark), _as_chunks(spark, sf_dir)
    counts = [store.insert(STORED, rows.filter("chunk_order % 2 = 0")), store.insert(STORED, rows), store.insert(STORED, rows)]
    fresh = store.chunks().filter("chunk_order % 2 = 1").groupBy("doc_id").agg(F.count("*").alias("fresh"))
    return fresh.withColumns({f"insert_{k}": F.lit(n).cast("long") for k, n in enumerate(counts, 1)})


def meta_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store's metadata after two writes of each language's key: the last one stands."""
    store = _store(spark)
    langs = table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).collect()  # one row a language
    store.put_meta(STORED.id, {r.lang: str(r.a) for r in langs})
    store.put_meta(STORED.id, {r.lang: str(r.b) for r in langs})
    store.initialize(STORED)
    return store.meta()


def model_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows by embedding model, and the store's own count."""
    store = _store(spark)
    store.insert(STORED, _as_chunks(spark, sf_dir))
    return store.models().withColumn("chunk_count", F.lit(store.stats(STORED)["chunk_count"]).cast("long"))


def delete_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store of two parts holds when one document is deleted and its files are gone."""
    store, rows = _store(spark), _as_chunks(spark, sf_dir)
    for part in (0, 1):
        store.insert(STORED, rows.filter(f"chunk_order % 2 = {part}"))
    store.delete(STORED.id, "src0")
    store.delete("other")
    store.vacuum()
    return store.chunks(STORED.id).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("chunk_order").alias("orders")).withColumn("chunk_count", F.lit(store.stats(STORED)["chunk_count"]).cast("long"))


def stored_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best stored chunks for the first benchmark item: an index grown by two inserts and a delete, packed, then filtered by type."""
    store, rows = _store(spark, stemmed=False, stop_words=()), _as_chunks(spark, sf_dir)
    for part in (0, 1):
        store.insert(STORED, rows.filter(f"chunk_order % 2 = {part}"))
    store.delete(STORED.id, "src0")
    store.rebuild_text_index(STORED)
    query = table(spark, sf_dir, "benchmark").filter("text IS NOT NULL").orderBy("item_id").select("text").first()
    return store.bm25_search(STORED, query.text if query else "", 10, {"content_type": "en"}).select("id", F.round("score", 6).alias("score"))


def stored_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten stored chunks nearest to a vector, by the store's own search."""
    store = _store(spark)
    store.insert(STORED, _as_chunks(spark, sf_dir))
    got = store.similarity_search(STORED, [0.6, -0.4, 0.5, 0.3], 10, {"doc_id": "src1"})
    return got.select("id", F.round("score", 5).alias("score"), "rank")


def ingest_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations ingested into a store, twice: chunks by content type, and how many each ingestion gave."""
    docs = conversations_markdown(spark, sf_dir).withColumn("doc_path", F.lit("conversations"))
    store = ChunkStore(spark, new_path(spark, "store"))
    counts = [ingest_documents(store, SOURCE, docs) for _ in range(2)]
    out = store.chunks(SOURCE.id).groupBy("content_type").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))
    return out.withColumns({f"ingest_{k}": F.lit(n).cast("long") for k, n in enumerate(counts, 1)})


def flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation chunks as flat rows with JSON arrays, and back again."""
    docs = conversations_markdown(spark, sf_dir).withColumn("doc_path", F.lit("conversations"))
    flat = to_flat(assemble(docs, SOURCE)).withColumn("tags", F.when(F.col("chunk_order") % 2 == 0, '["a", null, 3]').otherwise("{}"))
    back = from_flat(flat)
    return back.select("doc_id", "chunk_order", F.to_json("heading_path").alias("heading_path"), F.array_join("tags", ",").alias("tags"), "page", "edition", "parent_id", F.size("embedding").alias("dim"))


def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their headings in front."""
    path = F.when(F.col("doc_id") % 2 == 0, F.array("source", F.lit(""), "lang")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(fn.search_text(path, F.col("text")), 256).alias("search_sha256"))


def ingest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of all conversations as the store would get them."""
    docs = conversations_markdown(spark, sf_dir).withColumn("doc_path", F.lit("conversations"))
    rows = assemble(docs, SOURCE)
    return rows.select("id", "source_id", "doc_id", "doc_path", "chunk_order", "token_count", "content_type", "content_hash", "system", "license", "document_type", "embedding_model", F.sha2("text", 256).alias("text_sha256"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("v0"))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    content_type_counts, conversation_chunks, token_counts, normalized_hashes, token_lists, sentence_pieces, token_windows, budget_pieces, page_markers, form_feed_pages, paged_chunks, cached_pages, single_page,
    given_pages, text_files, heading_rules, constant_types, model_types, cost_forecast, service_embeddings, hash_embeddings, cosine_top_k, cosine_join, filtered_rows, bm25, bm25_stemmed, index_statistics, stems,
    dedup_insert, known_rows, meta_upsert, model_audit, delete_document, stored_bm25, stored_nearest, search_texts, ingest_plan, ingest_store, flat_rows,
)
