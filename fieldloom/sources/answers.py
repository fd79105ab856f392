"""Model answers for chunked requests, and answers that fail, rendered from the relational tables.

Both grow with the tables they come from.  Which chunk or document fails, and how,
follows from the document key, so the expected records can be stated in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.model_io import build_requests
from fieldloom.sources.corpus import ITEM_ORDER, PROVIDERS, dec2, money_text, render_invoices
from fieldloom.sources.tables import Tables

#: Characters per request: small, so that every rendered invoice takes three chunks or more.
CHUNK_LIMITS = {"google": 250, "openai": 200}
FAILURES = 12  # the kinds of failing answers, by key


def provider_of(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PROVIDERS]), (key % 2 + 1).cast("int"))


def envelope(provider: Column, content: Column) -> Column:
    """The response body of either provider around an answer text."""
    a = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(content.alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    b = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("assistant").alias("role"), content.alias("content")).alias("message"))).alias("choices")))
    return F.when(provider == "google", a).otherwise(b)


def _item_answers(t: Tables) -> DataFrame:
    """(doc_key, items): per order its items as JSON without the closing brace, in order."""
    item = F.concat(F.lit('{"Item/SKU Code":"P'), F.col("l_partkey").cast("string"), F.lit('","Quantity":'),
                    F.col("l_quantity").cast("bigint").cast("string"), F.lit(',"Line Total Value":"'),
                    money_text(F.col("l_extendedprice")), F.lit('"'))
    rows = t.lineitem.select("l_orderkey", F.struct(*ITEM_ORDER, item.alias("j")).alias("_s")).repartition("l_orderkey")
    return rows.groupBy(F.col("l_orderkey").alias("doc_key")).agg(F.array_sort(F.collect_list("_s")).alias("_i")) \
        .select("doc_key", F.transform("_i", lambda s: s["j"]).alias("items"))


def chunk_requests(t: Tables) -> DataFrame:
    """The request table of the rendered invoices, several chunks a document."""
    docs = render_invoices(t).withColumn("provider", provider_of(F.col("doc_key")))
    return build_requests(docs, limits=CHUNK_LIMITS)


def render_chunk_responses(t: Tables, requests: DataFrame) -> DataFrame:
    """``(doc_key, provider, chunk_no, n_chunks, http_status, body)`` for ``requests``.

    Every chunk answers with its share of the items, each numbered from 1.  The first
    has blank header values; the second the invoice number and buyer; the last
    one another number, a blank buyer and the total.  Key % 13 = 5: nothing came back for
    the second chunk; key % 13 = 6: the last one failed without a body; key % 17
    = 3: all failed; key % 19 = 1 (of the others): the first chunk failed once before it answered.
    """
    k, c, n = F.col("doc_key"), F.col("chunk_no"), F.col("n_chunks")
    total = t.orders.select(F.col("o_orderkey").alias("doc_key"), "o_totalprice")
    # items and total meet by document, before the chunks multiply their rows
    rows = requests.select("doc_key", "provider", "chunk_no", "n_chunks").join(_item_answers(t).join(total, "doc_key"), "doc_key")
    share = F.filter("items", lambda x, i: F.floor(i * n / F.size("items")) == c)
    numbered = F.transform(share, lambda x, i: F.concat(x, F.lit(',"Line Number":'), (i + 1).cast("string"), F.lit("}")))
    number = F.when(c == 1, F.concat(F.lit("INV/"), k.cast("string"))).when(c == n - 1, F.concat(F.lit("OTHER/"), k.cast("string"))).otherwise(F.lit(" "))
    buyer = F.when(c == 1, F.concat(F.lit("CLIENT "), k.cast("string"))).otherwise(F.lit(""))
    price = F.when(c == n - 1, dec2(F.col("o_totalprice")).cast("string")).otherwise(F.lit("null"))
    content = F.concat(F.lit('{"invoice_data":{"Invoice Number":"'), number, F.lit('","Buyer Name":"'), buyer, F.lit('","Total Invoice Value":'),
                       price, F.lit('},"line_items":['), F.array_join(numbered, ","), F.lit("]}"))
    down = (k % 17 == 3) | ((k % 13 == 6) & (c == n - 1))
    rows = rows.where(~((k % 13 == 5) & (c == 1))).select(
        "doc_key", "provider", "chunk_no", "n_chunks", F.when(down, 500).otherwise(200).alias("http_status"),
        F.when(~down, envelope(F.col("provider"), content)).alias("body"))
    # a retried chunk's row twice, in the same pass over the requests
    retried = (k % 19 == 1) & (k % 17 != 3) & (c == 0)
    rows = rows.select("*", F.explode(F.when(retried, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("_first"))
    return rows.select("doc_key", "provider", "chunk_no", "n_chunks", F.when(F.col("_first"), 504).otherwise(F.col("http_status")).alias("http_status"),
                       F.when(~F.col("_first"), F.col("body")).alias("body"))


def failing_documents(t: Tables) -> DataFrame:
    """The rendered invoices; the text is empty for key % 24 = 6 and NULL for key % 24 = 18."""
    k = F.col("doc_key")
    return render_invoices(t).select("doc_key", F.when(k % 24 == 6, F.lit("")).when(k % 24 == 18, F.lit(None).cast("string")).otherwise(F.col("text")).alias("text"))


def render_failing_responses(t: Tables) -> DataFrame:
    """``(doc_key, provider, http_status, body)``: by key % 12 a usable answer (0 and 6), status 500 with a body (1), 504
    without one (2), an answer that reports an error (3), an unknown provider (4), a
    malformed item (5), an answer that is not an object (7), a null header object (8),
    no response at all (9), no status (10), another envelope (11)."""
    k = F.col("doc_key")
    kind = k % FAILURES
    total = t.orders.select(F.col("o_orderkey").alias("doc_key"), "o_totalprice")
    rows = _item_answers(t).join(total, "doc_key").where(kind != 9)
    items = F.concat(F.array_join(F.transform("items", lambda x: F.concat(x, F.lit("}"))), ","), F.when(kind == 5, ",5").otherwise(""))
    head = F.when(kind == 8, F.lit("null")).otherwise(F.concat(F.lit('{"Invoice Number":"INV/'), k.cast("string"), F.lit('","Total Invoice Value":'),
                                                                dec2(F.col("o_totalprice")).cast("string"), F.lit("}")))
    content = F.when(kind == 3, F.lit('{"error":"no table found"}')).when(kind == 7, F.lit("[1]")).otherwise(
        F.concat(F.lit('{"invoice_data":'), head, F.lit(',"line_items":['), items, F.lit("]}")))
    provider = F.when(kind == 4, F.lit("mistral")).otherwise(provider_of(k))
    body = F.when(kind == 1, F.lit("overloaded")).when(kind == 2, F.lit(None).cast("string")).when(kind == 10, F.lit("no status")) \
        .when(kind == 11, F.lit('{"unexpected":true}')) \
        .otherwise(envelope(provider, content))
    status = F.when(kind == 1, 500).when(kind == 2, 504).when(kind != 10, 200)
    return rows.select("doc_key", provider.alias("provider"), status.cast("int").alias("http_status"), body.alias("body"))
