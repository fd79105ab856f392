"""Model request / response operators (M1-M15, T6, J7) as table jobs.

The hosted-model call itself is outside Spark: ``build_requests`` writes the
request table, an external caller fills a response table
``(doc_key, provider, http_status, body)``, and the functions here turn the
responses back into header and item records.  Everything is built-in
expressions (``from_json``, ``try_parse_json``, higher-order functions); a
malformed response never raises, it becomes a per-row ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions import patterns as P
from fieldloom.functions.contract import HEADER_COLUMNS, conform_headers, conform_items
from fieldloom.functions.rx import money, strip
from fieldloom.operators.header import minimal_fields, serial_number

# Request text around the document, characters per request, names.
REQUEST_PREFIX = (
    "\nExtract structured data from this invoice text. Return ONLY a valid JSON with two fields:\n"
    '1. "invoice_data": object with these fields: Document Type, Invoice Number, Invoice Date, '
    "Supplier Name, Supplier GSTIN, Supplier Address, Buyer Name, Buyer GSTIN, Buyer Address, "
    "Total Invoice Value\n"
    '2. "line_items": array of line items with fields: Line Number, Item/SKU Code, Item Description, '
    "Quantity, Unit Price, Tax Rate, Line Total Value\n\nINVOICE TEXT:\n")
REQUEST_SUFFIX = ("\n\nIMPORTANT: Return ONLY valid JSON without any explanation or markdown. Format:\n"
                  '{"invoice_data": {...}, "line_items": [...]}\n')
PROVIDER_LIMITS = {"google": 10000, "openai": 8000}
CHUNK = ["chunk_no", "n_chunks"]
ENVELOPES = {"google": "A", "openai": "B"}

HEADER_MAP = {  # response name -> record field
    "Document Type": "document_type",
    "Invoice Number": "invoice_document_number",
    "Invoice Date": "invoice_document_date",
    "Supplier Name": "supplier_name",
    "Supplier GSTIN": "supplier_gstin",
    "Supplier Address": "supplier_address",
    "Buyer Name": "buyer_name",
    "Buyer GSTIN": "buyer_gstin",
    "Buyer Address": "buyer_address",
    "Total Invoice Value": "total_invoice_value",
}
HEADER_NUMBERS = ["total_quantity", "subtotal_taxable_value", "cgst_amount", "sgst_amount", "igst_amount",
                  "cess_amount", "additional_charges", "total_invoice_value"]
ITEM_MAP = {
    "Line Number": "line_number",
    "Item/SKU Code": "item_sku_code",
    "Item Description": "item_description",
    "HSN Code": "hsn_code",
    "Quantity": "quantity",
    "Unit of Measurement": "uom",
    "Unit Price": "unit_price",
    "Discount": "discount",
    "Tax Rate": "tax_rate",
    "CGST Rate": "cgst_rate",
    "SGST Rate": "sgst_rate",
    "IGST Rate": "igst_rate",
    "CGST Amount": "cgst_amount",
    "SGST Amount": "sgst_amount",
    "IGST Amount": "igst_amount",
    "Line Total Value": "line_total_value",
}
ITEM_NUMBERS = ["quantity", "unit_price", "discount", "cgst_amount", "sgst_amount", "igst_amount",
                "line_total_value"]
REMARK_OK = "Extracted with {provider} LLM"
REMARK_MISSING = "; no answer for chunks "
ERR_FORMAT = {"google": "Unexpected API response format", "openai": "Unexpected OpenAI response format"}
ERR_PARSE = {"google": "Failed to parse JSON", "openai": "Failed to parse JSON from OpenAI response"}
ERR_OBJECT = "Answer is not a JSON object"
ERR_PROVIDER = "Unsupported LLM provider: "
ERR_NORMALISE = "Error normalizing data: argument of type 'NoneType' is not iterable"

_S = T.StringType()
ENVELOPE_A = T.StructType([T.StructField("candidates", T.ArrayType(T.StructType([
    T.StructField("content", T.StructType([T.StructField("parts", T.ArrayType(T.StructType([
        T.StructField("text", _S)])))]))])))])
ENVELOPE_B = T.StructType([T.StructField("choices", T.ArrayType(T.StructType([
    T.StructField("message", T.StructType([T.StructField("content", _S)]))])))])
ANSWER = T.StructType([
    T.StructField("invoice_data", _S), T.StructField("line_items", _S), T.StructField("error", _S)])
INVOICE_DATA = T.StructType([T.StructField(k, _S) for k in HEADER_MAP])
ITEM = T.StructType([T.StructField(k, _S) for k in ITEM_MAP])


def provider_name(provider: Column) -> Column:
    """``provider.capitalize()``."""
    p = F.lower(provider)
    return F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))


# --- M1-M3: requests ---------------------------------------------------------------


def build_requests(docs: DataFrame, provider: str | Column = "provider", prefix: str = REQUEST_PREFIX,
                   suffix: str = REQUEST_SUFFIX, limits: dict[str, int] | None = None) -> DataFrame:
    """``(doc_key, text[, provider])`` -> ``(doc_key, provider, chunk_no, n_chunks, request, error)``.

    A text longer than the provider takes in one request (code points) becomes
    consecutive chunks, a request row each, that together hold the whole text;
    the instructions go around every chunk.  An unknown provider gets an error
    instead of a request (route it to a quarantine table).
    """
    prov = F.col(provider) if isinstance(provider, str) and provider in docs.columns else (
        provider if isinstance(provider, Column) else F.lit(provider))
    p = F.lower(prov)
    limit = F.lit(None).cast("int")
    for name, size in (limits or PROVIDER_LIMITS).items():
        limit = F.when(p == name, F.lit(size)).otherwise(limit)
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / F.coalesce(F.col("_limit"), F.length(text) + 1))).cast("int")
    req = F.concat(F.lit(prefix), F.substring(text, F.col("chunk_no") * F.col("_limit") + 1, F.col("_limit")), F.lit(suffix))
    return (docs.select("doc_key", "text", p.alias("provider"), limit.alias("_limit"))
            .select("*", n.alias("n_chunks"))
            .select("*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_no"))
            .select("doc_key", "provider", "chunk_no", "n_chunks",
                    F.when(F.col("_limit").isNotNull(), req).alias("request"),
                    F.when(F.col("_limit").isNull(), F.concat(F.lit(ERR_PROVIDER), F.coalesce(F.col("provider"), F.lit(""))))
                    .alias("error")))


# --- M4-M8: responses -> answer JSON or error ------------------------------------------


def unwrap(responses: DataFrame) -> DataFrame:
    """``(doc_key, provider, http_status, body)`` -> ``(doc_key, provider, answer, error)``;
    ``chunk_no`` and ``n_chunks`` are kept where the responses have them.

    ``answer`` is the model's JSON text after fence removal; ``error`` is set
    for an unknown provider, non-200 statuses (with or without a body),
    unexpected envelopes, unparsable JSON, JSON that is not an object, and an
    answer that itself reports an ``error``.
    """
    b = F.col("body")
    prov = F.lower(F.col("provider"))
    is_a = prov == "google"
    named = lambda m: F.when(prov == "openai", F.lit(m["openai"])).otherwise(F.lit(m["google"]))
    a_parts = F.get(F.from_json(b, ENVELOPE_A)["candidates"], 0)["content"]["parts"]
    a_text = F.get(F.filter(a_parts, lambda x: x["text"].isNotNull()), 0)["text"]
    b_text = F.get(F.from_json(b, ENVELOPE_B)["choices"], 0)["message"]["content"]
    raw = F.when(is_a, a_text).otherwise(b_text)
    x = F.regexp_replace(F.col("_raw"), r"(?d)^```json", "")
    x = F.when(is_a, x).otherwise(F.regexp_replace(x, r"(?d)^```", ""))
    x = strip(F.regexp_replace(x, r"(?d)```$", ""))
    keys = ["doc_key", "provider", *[c for c in CHUNK if c in responses.columns]]
    s1 = responses.select(*keys, "http_status", "body", raw.alias("_raw"))
    s2 = s1.select("*", x.alias("_clean"))
    status_ok = F.col("http_status") == 200
    s2 = s2.select("*", F.try_parse_json(F.col("_clean")).alias("_json"))
    # a name that JSON escapes has a backslash
    told = F.when(F.col("_clean").contains("error") | F.col("_clean").contains("\\"), F.get_json_object("_clean", "$.error"))
    err = (F.when(~F.coalesce(prov.isin(list(ENVELOPES)), F.lit(False)),
                  F.concat(F.lit(ERR_PROVIDER), F.coalesce(F.col("provider"), F.lit(""))))
           .when(~F.coalesce(status_ok, F.lit(False)),
                 F.concat(F.lit("API error: "), F.coalesce(F.col("http_status").cast("string"), F.lit("none")),
                          F.lit(" - "), F.coalesce(F.col("body"), F.lit(""))))
           .when(F.col("_raw").isNull(), named(ERR_FORMAT))
           .when(F.col("_json").isNull(), named(ERR_PARSE))
           .when(~F.col("_clean").startswith("{"), F.lit(ERR_OBJECT))
           .when(told.isNotNull(), told))
    s3 = s2.select(*keys, F.col("_clean").alias("answer"), err.alias("error"))
    return s3.select(*keys,
                     F.when(F.col("error").isNull(), F.col("answer")).alias("answer"), "error")


# --- M9-M14: normalisation -------------------------------------------------------------------


def _parsed(df: DataFrame, col: Column, schema, name: str) -> DataFrame:
    """Parse JSON once into a struct column.

    Fields are read from that column in the next projection.  Written as
    ``from_json(x)[field]`` instead, Catalyst prunes the schema per field access
    and the text is parsed once per field read.
    """
    return df.select("*", F.from_json(col, schema).alias(name))


def _no_header(answer: Column) -> Column:
    """The answer's header object is an explicit null: nothing can be normalised."""
    # two plain searches: white space holds no quote, so the name stands behind the brace anyway, and a
    # pattern that reads on to the end and comes back costs more than the parsing of the answer
    return answer.contains("null") & answer.rlike(r'^\s*\{') & answer.rlike(r'"invoice_data"\s*:\s*null')


def _answer_parts(df: DataFrame) -> DataFrame:
    a = _parsed(df, F.col("answer"), ANSWER, "_ans")
    return a.select(*df.columns, F.col("_ans.invoice_data").alias("_inv_json"),
                    F.col("_ans.line_items").alias("_items_json"), F.col("_ans.error").alias("_ans_error"),
                    _no_header(F.col("answer")).alias("_inv_null"))


def normalise_headers(answers: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_key, provider, answer)`` -> header records (30 fields);
    ``keep`` carries extra response columns (e.g. ``provider``, ``error``)."""
    a = _parsed(_answer_parts(answers), F.col("_inv_json"), INVOICE_DATA, "_inv")
    cols = {field: F.col("_inv")[name] for name, field in HEADER_MAP.items()}
    for n in HEADER_NUMBERS:
        if n in cols:
            cols[n] = money(cols[n])
    remark = (F.when(F.col("_ans_error").isNotNull(),
                     F.concat(F.lit("Error in LLM extraction: "), F.col("_ans_error")))
              .when(F.col("_inv_json").isNull() & F.col("_inv_null"), F.lit(ERR_NORMALISE))
              .otherwise(F.concat(F.lit("Extracted with "), provider_name(F.col("provider")), F.lit(" LLM"))))
    usable = F.col("_ans_error").isNull()
    out = a.select("doc_key", *keep, serial_number(F.col("doc_key")).alias("serial_number"),
                   *[F.when(usable, c).alias(k) for k, c in cols.items()],
                   remark.alias("additional_remarks"))
    out = out.withColumn("document_type", F.coalesce(F.col("document_type"), F.lit(P.DEFAULT_DOC_TYPE)))
    return conform_headers(out, ("doc_key",) + tuple(keep))


def _malformed(e: Column) -> Column:
    """An element of ``line_items`` that no record can be read from."""
    first = F.substring(F.ltrim(e), 1, 1)
    is_obj, is_str, is_list = first == "{", first == '"', first == "["
    str_hit = F.lit(False)
    for n in ITEM_MAP:
        str_hit = str_hit | e.contains(n)
    return e.isNull() | ~(is_obj | is_str | is_list) | (is_str & str_hit)


def normalise_items(answers: DataFrame) -> DataFrame:
    """Explode ``line_items``; the response's line number wins over the
    position (but where a column ``n_chunks`` is above one, as each chunk numbers its own
    lines); one malformed element empties the answer's whole list."""
    a = _parsed(_answer_parts(answers), F.col("_items_json"), T.ArrayType(_S), "_all")
    elems = F.col("_all")
    several = F.col("n_chunks") > 1 if "n_chunks" in answers.columns else F.lit(False)

    b = a.select("doc_key", several.alias("_several"), F.get_json_object(F.col("_inv_json"), "$['Invoice Number']").alias("_inv_no"),
                 F.when(F.col("_ans_error").isNull() & ~F.col("_inv_null") & ~F.exists(elems, _malformed), elems).alias("_elems"))
    # the outer generator: a plain one lets Spark infer size(_elems) > 0 and push it, with all
    # of the JSON parsing that _elems stands for, into whatever join lies below
    c = b.select("doc_key", "_several", "_inv_no", F.posexplode_outer("_elems").alias("_pos", "_e")).where(F.col("_pos").isNotNull())
    c = _parsed(c, F.when(F.substring(F.ltrim(F.col("_e")), 1, 1) == "{", F.col("_e")), ITEM, "_item")
    cols = {field: F.col("_item")[name] for name, field in ITEM_MAP.items()}
    for n in ITEM_NUMBERS:
        cols[n] = money(cols[n])
    own = F.when(~F.col("_several"), cols["line_number"].try_cast("int"))
    cols["line_number"] = F.coalesce(own, (F.col("_pos") + 1).cast("int"))
    out = c.select("doc_key", serial_number(F.col("doc_key")).alias("invoice_serial_number"),
                   F.coalesce(F.col("_inv_no"), F.lit("")).alias("invoice_number"),
                   *[v.alias(k) for k, v in cols.items()])
    return conform_items(out)


# --- M15, T6, J7: routing ----------------------------------------------------------------------


def latest_responses(responses: DataFrame, order: str = "received_at") -> DataFrame:
    """One response per document, or per chunk where ``chunk_no`` tells them apart, for callers
    that retry: the latest by ``order``; without that column, an answer with status 200
    before one without (then the larger body)."""
    rank = F.struct(F.col(order)) if order in responses.columns else F.struct(
        F.coalesce(F.col("http_status") == 200, F.lit(False)), F.col("body"), F.col("provider"), F.col("http_status"))
    keys = ["doc_key", *[c for c in CHUNK[:1] if c in responses.columns]]
    row = F.struct(*[F.col(c) for c in responses.columns if c not in keys])
    best = responses.groupBy(*keys).agg(F.max_by(row, rank).alias("_r"))
    return best.select(*keys, "_r.*")


def missing_chunks(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """``(doc_key, chunk_no, n_chunks, reason)``: the requests that no usable answer came back for.

    ``reason`` is the error of the latest answer, of the request itself (unknown
    provider), or ``no response``.
    """
    # only whether there is an answer: joining by chunk shuffles these rows
    answered = unwrap(latest_responses(responses)).select("doc_key", "chunk_no", F.col("answer").isNotNull().alias("_usable"), F.col("error").alias("_error"))
    asked = requests.select("doc_key", "chunk_no", "n_chunks", F.col("error").alias("_asked"))
    j = asked.join(answered, ["doc_key", "chunk_no"], "left").where(~F.coalesce("_usable", F.lit(False)))
    return j.select("doc_key", "chunk_no", "n_chunks", F.coalesce("_error", "_asked", F.lit("no response")).alias("reason"))


def merge_chunks(responses: DataFrame) -> DataFrame:
    """The answers to a document's chunks as one: ``(doc_key, provider, answer, error, n_chunks, missing)``.

    Chunks are taken in the order of ``chunk_no``: the first non-blank value of each
    header field wins, item lists follow each other (a malformed element
    empties its chunk's list).  ``missing`` lists the chunks without a usable answer, in
    order; a document without any usable chunk has the error of its first one.  A
    document of a single chunk keeps its answer as it is.  Responses without
    ``n_chunks`` are taken for complete up to their largest ``chunk_no``.
    """
    # by document at once: this also clusters (document, chunk), so there is one shuffle
    by_doc = latest_responses(responses.repartition("doc_key"))
    u = unwrap(by_doc if "n_chunks" in responses.columns else by_doc.withColumn("n_chunks", F.lit(None).cast("int")))
    u = _parsed(u, F.col("answer"), ANSWER, "_ans")
    u = u.withColumn("error", F.coalesce("error", "_ans.error"))
    u = _parsed(u, F.col("_ans.invoice_data"), INVOICE_DATA, "_inv")
    u = _parsed(u, F.col("_ans.line_items"), T.ArrayType(_S), "_all")
    ok = F.col("error").isNull() & F.col("answer").isNotNull()
    kept = F.when(ok & ~_no_header(F.col("answer")) & ~F.exists("_all", _malformed), F.col("_all"))
    quoted = lambda e: F.concat(F.lit('"'), F.replace(F.replace(e, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    raw = F.transform(kept, lambda e: F.when(F.substring(F.ltrim(e), 1, 1) == '"', quoted(e)).otherwise(e))
    chunk = F.struct("chunk_no", ok.alias("ok"), "provider", "answer", "error", F.col("_inv").alias("inv"), raw.alias("items"))
    d = u.groupBy("doc_key").agg(F.array_sort(F.collect_list(chunk)).alias("_c"),
                                 F.greatest(F.max("n_chunks"), F.max("chunk_no") + 1).alias("n_chunks"))
    usable = F.filter("_c", lambda c: c["ok"])
    blank = lambda v: v.isNull() | (strip(v) == "")
    d = d.select("doc_key", "n_chunks", "_c", usable.alias("_u"))
    first = lambda name: F.get(F.filter(F.transform("_u", lambda c: c["inv"][name]), lambda v: ~blank(v)), F.lit(0))
    inv = F.to_json(F.struct(*[first(name).alias(name) for name in HEADER_MAP]))
    items = F.concat(F.lit("["), F.array_join(F.flatten(F.transform("_u", lambda c: F.coalesce(c["items"], F.array().cast("array<string>")))), ","), F.lit("]"))
    merged = F.concat(F.lit('{"invoice_data":'), inv, F.lit(',"line_items":'), items, F.lit("}"))
    any_ok = F.size("_u") > 0
    answer = F.when(any_ok, F.when(F.col("n_chunks") == 1, F.col("_u")[0]["answer"]).otherwise(merged))
    missing = F.array_except(F.sequence(F.lit(0), F.col("n_chunks") - 1), F.transform("_u", lambda c: c["chunk_no"]))
    provider = F.when(any_ok, F.get("_u", F.lit(0))["provider"]).otherwise(F.col("_c")[0]["provider"])
    return d.select("doc_key", provider.alias("provider"), answer.alias("answer"),
                    F.when(~any_ok, F.col("_c")[0]["error"]).alias("error"), "n_chunks", missing.alias("missing"))


def _answers(responses: DataFrame) -> DataFrame:
    """One answer per document: its chunks merged, where responses come by chunk."""
    return merge_chunks(responses) if "chunk_no" in responses.columns else unwrap(latest_responses(responses))


def route_headers(docs: DataFrame, responses: DataFrame) -> DataFrame:
    """M15 + T6: one header per document.

    Empty text -> the 4-field failure record; a failed call -> the ``minimal``
    regex fallback over the document text; otherwise the normalised answer, merged
    from all chunks of a long document.  Where some but not all chunks have a usable
    answer, the remark names the others.
    Documents and responses are joined on ``doc_key`` (both sides are
    partitioned by it, so the join reuses that partitioning).
    """
    # one pass over the responses (failed answers normalise to NULL fields and
    # are replaced by the fallback below), one join with the documents
    answers = _answers(responses)
    chunked = [c for c in ("missing",) if c in answers.columns]
    norm = normalise_headers(answers, keep=("provider", "error", *chunked))
    j = docs.select("doc_key", "text").join(norm, "doc_key", "left")
    t = F.col("text")
    fb = minimal_fields(t, F.coalesce(F.col("provider"), F.lit("")))
    empty = F.coalesce(t, F.lit("")) == ""
    failed = F.col("error").isNotNull() | F.col("provider").isNull()
    sel = [F.col("doc_key"), serial_number(F.col("doc_key")).alias("serial_number")]
    for c in HEADER_COLUMNS:
        if c == "serial_number":
            continue
        normal = F.col(c)
        if c == "additional_remarks" and chunked:
            normal = F.when(F.size("missing") > 0, F.concat(normal, F.lit(REMARK_MISSING), F.array_join(F.col("missing").cast("array<string>"), ", "))) \
                .otherwise(normal)
        val = F.when(failed, fb[c] if c in fb else F.lit(None)).otherwise(normal)
        if c == "additional_remarks":
            val = F.when(empty, F.lit(P.EMPTY_TEXT_REMARK)).otherwise(val)
        elif c == "document_type":
            val = F.when(empty, F.lit(P.DEFAULT_DOC_TYPE)).otherwise(val)
        else:
            val = F.when(empty, F.lit(None)).otherwise(val)
        sel.append(val.alias(c))
    return conform_headers(j.select(*sel))


def route_items(docs: DataFrame, responses: DataFrame) -> DataFrame:
    """Items only for documents with text and a usable answer; of a long document, those of all
    its chunks, numbered through."""
    ans = _answers(responses)
    ans = ans.select("doc_key", "provider", *[c for c in CHUNK if c in ans.columns],
                     F.when(F.col("error").isNull(), F.col("answer")).alias("answer"))
    ok_docs = docs.where(F.coalesce(F.col("text"), F.lit("")) != "").select("doc_key")
    return normalise_items(ans.join(ok_docs, "doc_key", "left_semi"))


def fallback_used(remarks: Column) -> Column:
    """Whether the regex fallback produced the record (ignore case)."""
    return F.lower(remarks).contains("fallback")
