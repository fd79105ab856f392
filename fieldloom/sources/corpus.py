"""Document corpora derived from the relational test tables.

``render_invoices`` turns ``orders ⋈ lineitem ⋈ part ⋈ customer ⋈ supplier``
into one invoice text per order that has lines; ``render_responses`` turns the
same tables into one model response per order.  Both are pure DataFrame
plans, so they grow with the tables and run distributed.

Plan shape (see ``explain``): lineitem ⋈ part on the part key (sort-merge, or
broadcast when the part side is under the size-checked broadcast threshold),
one shuffle by order key followed by the per-order aggregation in the same
stage (the item lines collected per order, which TPC-H bounds to 7), then
orders joined on the same key (reusing that hash partitioning) and the
customer / supplier attributes joined by key.  No window, no second sort: the
item order is an ``array_sort`` of structs inside the aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.tables import Tables

# Fixed values of the rendered corpus (document titles by key % 4, number labels
# by key % 3, id suffix, HSN offset, e-way offset).
DOC_TITLES = ["TAX INVOICE", "DELIVERY CHALLAN", "STOCK TRANSFER", "STATEMENT"]
NUMBER_LABELS = ["Invoice No: ", "Document No: ", "Bill No. : "]
ITEM_HEADER = "Sr No  Item Code  Description  HSN  Qty  Rate  Amount"
TAXID_SUFFIX = "F1Z5"
HSN_OFFSET = 61000000
EWAY_OFFSET = 100000000000

# Sort keys that make the item order total (the (order, line number) pair repeats).
ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
              "l_quantity", "l_discount", "l_tax"]


def dec2(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def money_text(c: Column) -> Column:
    """``#,##0.00`` of a 2-decimal value."""
    return F.format_number(dec2(c), 2)


def tax_id(nationkey: Column, key: Column) -> Column:
    """15-character tax id: nation+1 (2 digits), key%100000 as letters A-J, key%10000, suffix."""
    return F.concat(
        F.format_string("%02d", (nationkey + 1).cast("bigint")),
        F.translate(F.format_string("%05d", key % 100000), "0123456789", "ABCDEFGHIJ"),
        F.format_string("%04d", key % 10000),
        F.lit(TAXID_SUFFIX),
    )


def item_lines(t: Tables) -> DataFrame:
    """One rendered item line per lineitem row (parts separated by two spaces), dealt by order.

    The values are shuffled and the line is made from them there: it would repeat them.
    """
    li = t.lineitem.select("l_orderkey", *ITEM_ORDER)
    part = t.part.select("p_partkey", "p_name", "p_brand", "p_retailprice")
    j = li.join(part, li.l_partkey == part.p_partkey, "left").select("l_orderkey", *ITEM_ORDER, "p_name", "p_brand", "p_retailprice") \
        .repartition("l_orderkey")
    line = F.concat(
        F.lit("P"), j.l_partkey.cast("string"), F.lit("_"),
        F.upper(F.regexp_replace(j.p_brand, "#", "")),
        F.lit("  "), j.p_name,
        F.lit("  "), (F.lit(HSN_OFFSET) + j.l_partkey).cast("string"),
        F.lit("  "), j.l_quantity.cast("bigint").cast("string"), F.lit(" PCS"),
        F.lit("  "), dec2(j.p_retailprice).cast("string"),
        F.lit("  "), F.round(j.l_tax * 100).cast("bigint").cast("string"), F.lit("%"),
        F.lit("  "), dec2(j.l_extendedprice).cast("string"),
    )
    return j.select("l_orderkey", *ITEM_ORDER, line.alias("line"))


def order_facts(t: Tables) -> DataFrame:
    """Per order: supplier key, quantity and value sums, ordered item lines.

    The lines are hash-partitioned by order key before the aggregation: the
    aggregation's required distribution is then already met (one shuffle, as
    before), and no map-side partial ``collect_list`` runs - it would not reduce
    anything (every line survives into the list) and falls back to a sort.
    """
    lines = item_lines(t)
    srt = F.struct(*[F.col(c) for c in ITEM_ORDER], F.col("line"))
    return (lines.groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("supp_key"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("total_qty"),
        F.sum(dec2(F.col("l_extendedprice"))).alias("taxable"),
        F.array_sort(F.collect_list(srt)).alias("items"),
    ).select(F.col("l_orderkey").alias("doc_key"), "supp_key", "total_qty", "taxable",
             F.transform("items", lambda s: s["line"]).alias("lines")))


def invoice_parts(t: Tables) -> DataFrame:
    """Order facts joined with the order, customer and supplier attributes.

    Customers join the narrow order rows, so that no item lines are shuffled by customer.
    """
    facts = order_facts(t)
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    s = t.supplier.select("s_suppkey", "s_nationkey")
    oc = o.join(c, F.col("o_custkey") == c.c_custkey, "left")
    return (facts.join(oc, facts.doc_key == oc.o_orderkey)
            .join(s, F.col("supp_key") == s.s_suppkey, "left"))


def _text(p: DataFrame) -> Column:
    k = F.col("doc_key")
    vendor = F.concat(F.lit("VENDOR "), F.format_string("%06d", F.col("supp_key")), F.lit(" PRIVATE LIMITED"))
    q = F.col("total_qty")
    title = F.element_at(F.array(*[F.lit(x) for x in DOC_TITLES]), (k % 4 + 1).cast("int"))
    label = F.element_at(F.array(*[F.lit(x) for x in NUMBER_LABELS]), (k % 3 + 1).cast("int"))
    even = (k % 2) == 0
    return F.concat_ws(
        "\n",
        title,
        vendor,
        F.concat(label, F.lit("INV/"), k.cast("string")),
        F.concat(F.lit("Invoice Date: "), F.date_format(F.col("o_orderdate"), "dd-MM-yyyy")),
        F.lit("Supplier"),
        F.concat(F.lit("Trade Name: "), vendor),
        F.concat(F.lit("Address: "), F.col("s_nationkey").cast("string"), F.lit(" Mill Road, District "),
                 F.col("supp_key").cast("string")),
        F.concat(F.lit("Supplier GSTIN: "), tax_id(F.col("s_nationkey"), F.col("supp_key"))),
        F.lit(""),
        F.lit("Bill to"),
        F.concat(F.lit("Legal Name: CLIENT "), F.format_string("%06d", F.col("o_custkey"))),
        F.concat(F.lit("Address: "), F.col("c_nationkey").cast("string"), F.lit(" Lake Street")),
        F.concat(F.lit("Customer GSTIN: "), tax_id(F.col("c_nationkey"), F.col("o_custkey"))),
        F.lit(""),
        F.lit(ITEM_HEADER),
        F.array_join(F.col("lines"), "\n"),
        F.concat(F.lit("Total Quantity: "), q.cast("string")),
        F.concat(F.lit("Taxable Value: "), F.format_number(F.col("taxable"), 2)),
        F.when(even, F.concat(F.lit("CGST: "), F.format_number(dec2(q * 9), 2))),
        F.when(even, F.concat(F.lit("SGST: "), F.format_number(dec2(q * 9), 2))),
        F.when(~even, F.concat(F.lit("IGST: "), F.format_number(dec2(q * 18), 2))),
        F.when(k % 5 == 0, F.concat(F.lit("CESS: "), F.format_number(dec2(q), 2))),
        F.concat(F.lit("Total Invoice Value: Rs. "), money_text(F.col("o_totalprice"))),
        F.concat(F.lit("Amount in Words: Rupees "), F.lower(F.col("c_mktsegment")), F.lit(" Only")),
        F.concat(F.lit("IRN: "), F.sha2(k.cast("string"), 256)),
        F.concat(F.lit("E-Way Bill No: "), (F.lit(EWAY_OFFSET) + k).cast("string")),
    )


def render_invoices(t: Tables) -> DataFrame:
    """``(doc_key bigint, text string)``: one invoice text per order with lines."""
    p = invoice_parts(t)
    return p.select("doc_key", _text(p).alias("text"))


# --- model responses -------------------------------------------------------

PROVIDERS = ["google", "openai"]  # by key % 2


def _json_str(c: Column) -> Column:
    """A JSON string literal for text without quotes/backslashes/control chars."""
    return F.concat(F.lit('"'), c, F.lit('"'))


def render_response_texts(t: Tables) -> DataFrame:
    """``(doc_key, provider, content)``: the model's answer text per order.

    Base form ``{"invoice_data":{...},"line_items":[...]}``; the total is a bare
    number (key % 3 = 0), a rupee string (1) or null (2).  Key % 11 = 0 lacks the
    closing brace (invalid JSON); key % 7 = 0 wraps it in a json code
    fence, key % 7 = 1 in a bare fence (valid only after the second provider's
    clean-up).
    """
    li = t.lineitem.select("l_orderkey", *ITEM_ORDER)
    item = F.concat(
        F.lit('{"Item/SKU Code":"P'), F.col("l_partkey").cast("string"), F.lit('","Quantity":'),
        F.col("l_quantity").cast("bigint").cast("string"), F.lit(',"Line Total Value":'),
        _json_str(money_text(F.col("l_extendedprice"))), F.lit("}"))
    srt = F.struct(*[F.col(c) for c in ITEM_ORDER], item.alias("j"))
    facts = (li.select("l_orderkey", srt.alias("_s")).repartition("l_orderkey").groupBy("l_orderkey")
             .agg(F.array_sort(F.collect_list("_s")).alias("items"))
             .select(F.col("l_orderkey").alias("doc_key"),
                     F.array_join(F.transform("items", lambda s: s["j"]), ",").alias("items_json")))
    o = t.orders.select("o_orderkey", "o_totalprice")
    j = facts.join(o, facts.doc_key == o.o_orderkey)
    k = F.col("doc_key")
    total = (F.when(k % 3 == 0, dec2(F.col("o_totalprice")).cast("string"))
             .when(k % 3 == 1, _json_str(F.concat(F.lit("₹"), money_text(F.col("o_totalprice")))))
             .otherwise(F.lit("null")))
    body = F.concat(F.lit('{"invoice_data":{"Invoice Number":"INV/'), k.cast("string"),
                    F.lit('","Total Invoice Value":'), total, F.lit('},"line_items":['),
                    F.col("items_json"), F.lit("]}"))
    body = F.when(k % 11 == 0, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    content = (F.when(k % 7 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
               .when(k % 7 == 1, F.concat(F.lit("```\n"), body, F.lit("\n```")))
               .otherwise(body))
    provider = F.element_at(F.array(*[F.lit(x) for x in PROVIDERS]), (k % 2 + 1).cast("int"))
    return j.select("doc_key", provider.alias("provider"), content.alias("content"))


def render_responses(t: Tables) -> DataFrame:
    """``(doc_key, provider, http_status, body)``: the provider envelope around the answer.

    Envelope A (first provider): ``candidates[0].content.parts[*].text``;
    envelope B (second provider): ``choices[0].message.content``.  Built with
    ``to_json`` so any text is escaped correctly.
    """
    r = render_response_texts(t)
    env_a = F.to_json(F.struct(F.array(F.struct(F.struct(
        F.array(F.struct(F.col("content").alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    env_b = F.to_json(F.struct(F.array(F.struct(F.struct(
        F.lit("assistant").alias("role"), F.col("content").alias("content")).alias("message"))).alias("choices")))
    body = F.when(F.col("provider") == "google", env_a).otherwise(env_b)
    return r.select("doc_key", "provider", F.lit(200).alias("http_status"), body.alias("body"))
