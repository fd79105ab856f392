"""Header-field operators (one row per document) for the regex profiles.

``extract_headers(docs, profile)`` maps ``(doc_key, text)`` to ``doc_key`` plus
the 30 header fields.  Profiles:

* ``simple``  - label cascades, first non-blank value wins, loose numbers.
* ``layout``  - colon-required labels, first matching pattern wins, strict
  numbers, 2-decimal rounding.  Two alternation defects of the behaviour being
  reproduced (role words and number labels written as an unparenthesised
  alternation, which raises on most documents) are built in their intended
  grouped form; see ``layout_gstin`` and ``_layout_number``.
* ``minimal`` - the 12-field fallback used when a model response is unusable.

Plan: a narrow projection with no shuffle.  Work is staged in three
``select``s (raw captures -> derived values -> back-fills) so that every
regex runs once per document; Catalyst keeps the stages apart rather than
duplicating the expensive expressions.

The text is folded once (``_low``, see ``rx.fold``).  Numbers and places are searched in it without
ignoring case, and a pattern whose words it lacks isn't tried: searching the
whole text ignoring case, once per field, is what extraction costs most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import patterns as P
from fieldloom.functions.contract import conform_headers
from fieldloom.functions.rx import (collapse_ws, contains_ci, extract, extract_ci, extract_folded, first_matching,
                                    first_nonblank, first_value, fold, folded, from_first, has_any, is_upper,
                                    lines_stripped_nonblank, filled, matches, number_loose, number_strict,
                                    one_of, positive, py, rest_from, strip, text_from)

PROFILES = ("simple", "layout", "minimal")


def serial_number(doc_key: Column) -> Column:
    """Stable record identity derived from the document key (never random)."""
    return doc_key.cast("string")


# --- shared field operators ------------------------------------------------------


def document_type(text: Column, types=P.DOC_TYPES, default=P.DEFAULT_DOC_TYPE) -> Column:
    """First listed type contained in the text (ignore case)."""
    low = F.lower(text)
    out = F.lit(default)
    for t in reversed(types):
        out = F.when(low.contains(t.lower()), F.lit(t)).otherwise(out)
    return out


def tax_ids_all(text: Column) -> Column:
    """Every tax id in the text, case-sensitive, in order."""
    return F.regexp_extract_all(text, F.lit(py(f"({P.TAXID})")), 1)


# --- simple profile ---------------------------------------------------------------


def simple_invoice_number(text: Column, vendor_pattern: str = P.VENDOR_NUMBER, low: Column | None = None) -> Column:
    """H3: five alternatives, first non-blank wins, default ``UNKNOWN``."""
    low = fold(text) if low is None else low
    needs = [has_any(low, [w]) for w in P.SIMPLE_NUMBER_WORDS] + [F.lit(True)]
    return first_nonblank(text, P.SIMPLE_NUMBER + [vendor_pattern], "is", P.SIMPLE_NUMBER_DEFAULT, needs, low)


def simple_date(text: Column) -> Column:
    """H6 (simple): four labelled forms, then any numeric date."""
    return first_nonblank(text, P.SIMPLE_DATE + [P.ANY_DATE], "is", "")


def id_after(text: Column, start: str, low: Column | None = None) -> Column:
    """The first tax id after the first ``start`` (words, with ``|`` between them); NULL without one.
    Given the folded text, the first ``start`` is looked up in it."""
    if low is not None:
        rest = text_from(text, low, one_of(start.split("|")))
        return filled(extract(rest, rf"\A(?:{start})(?s:.*?)({P.TAXID})", "i"))
    start = f"(?:{start})"
    return filled(extract(text, from_first(start, rf"(?s:.*?)({P.TAXID})"), "i"))


def simple_gstin(text: Column, role: str, all_ids: Column, label_at: Column, label_id: Column, low: Column | None = None,
                 labelled: Column | None = None) -> Column:
    """H8: tax id for a role, see ``P.SIMPLE_ID_ROLES``.

    In this order: an id behind one of the role's labels; whatever comes first of a bare role word (the
    answer is then ``""``, the search stops) and ``GSTIN`` with an id somewhere after it
    (``label_at``: its first place; ``label_id``: that id); ``GSTIN: id``; the id at the role's place among all
    ids, else the first one.  ``labelled``: the id behind a label, where it is known.  The others
    are asked for only without it, so they may be NULL then.
    """
    labels, words, place = P.SIMPLE_ID_ROLES[role]
    low = fold(text) if low is None else low
    labelled = labelled_id(text, labels, low) if labelled is None else labelled
    role_at = F.when(has_any(low, words.split("|")), first_at(low, one_of(folded(words).split("|")), "")).otherwise(F.lit(0))
    bare = (role_at > 0) & (label_id.isNull() | (role_at < label_at))
    by_place = F.coalesce(F.get(all_ids, place), F.get(all_ids, 0))
    return F.coalesce(labelled, F.when(bare, F.lit("")).otherwise(label_id),
                      filled(extract_ci(text, low, P.GENERIC_ID_LABEL)), by_place, F.lit(""))


def labelled_id(text: Column, labels: list[str], low: Column) -> Column:
    """The id behind the first of the labels that has one; NULL without any."""
    # a captured id is never empty; each label begins with its word
    return F.coalesce(*[F.when(has_any(low, [p.split("\\s")[0]]), filled(extract_ci(text, low, p))) for p in labels])


def first_at(text: Column, pattern: str, flags: str = "i") -> Column:
    """1-based place of the first match, 0 without one."""
    return F.regexp_instr(text, F.lit(py(pattern, flags)))


def section(text: Column, keywords: list[str], low: Column | None = None) -> Column:
    """P11 (simple parties): text from the first keyword that matches up to
    ``GSTIN``, ``PAN`` or a blank line; NULL when no keyword matches.

    Tried at a keyword's first place only: if no end follows it, none follows a later one.
    """
    low = fold(text) if low is None else low

    def tried(kw: str) -> Column:
        rest = text_from(text, low, one_of([kw, f"Details of {kw}"]))
        return extract(rest, rf"\A((?:{kw}|Details of {kw}){P.SECTION_TAIL})", "is")

    return F.coalesce(*[F.when(has_any(low, [kw]), filled(tried(kw))) for kw in keywords])


def _first_index(arr: Column, pred) -> Column:
    """0-based index of the first element satisfying ``pred`` (NULL if none)."""
    hits = F.filter(F.transform(arr, lambda x, i: F.when(pred(x), i)), lambda v: v.isNotNull())
    return F.get(hits, 0)


def party_name_raw(sec: Column, keywords: list[str]) -> Column:
    """H11 name: the ``Legal/Trade Name`` value of the section, else its first
    line without a keyword (leading colons not yet removed)."""
    lines = lines_stripped_nonblank(sec)

    def no_kw(x):
        return ~_any([contains_ci(x, k) for k in keywords])
    name_fb = F.coalesce(F.get(F.filter(lines, no_kw), 0), F.lit(""))
    # a matching label's value is never empty
    return F.coalesce(strip(filled(extract(sec, P.SECTION_NAME, "i"))), name_fb)


def party_address(sec: Column, raw_name: Column) -> Column:
    """H11 address: the ``Address`` value, else the lines after the first line
    containing the name, up to a tax-id line, joined with ``, ``.

    ``raw_name`` should be a column: it is referenced inside a lambda, where
    Spark does not share common subexpressions.
    """
    lines = lines_stripped_nonblank(sec)
    at = _first_index(lines, lambda x: x.contains(raw_name))
    after = F.slice(lines, at + 2, F.greatest(F.size(lines), F.lit(1)))
    stop = _first_index(after, lambda x: matches(x, P.TAX_LINE, "i"))
    taken = F.when(stop.isNull(), after).otherwise(F.slice(after, 1, stop))
    addr_fb = F.when(at.isNull(), F.lit("")).otherwise(F.coalesce(F.array_join(taken, ", "), F.lit("")))
    address = F.coalesce(strip(filled(extract(sec, P.SECTION_ADDRESS, "i"))), addr_fb)
    return F.when(sec.isNull(), F.lit("")).otherwise(address)


def party_name(sec: Column, raw_name: Column) -> Column:
    """H11 name with leading colons and spaces removed; '' without a section."""
    return F.when(sec.isNull(), F.lit("")).otherwise(F.regexp_replace(raw_name, py(r"^[:\s]+"), ""))


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def company_name(text: Column, doc_type: Column) -> Column:
    """First line that is all caps or names a company form, skipping lines
    that contain the document type."""
    def ok(x):
        ux = F.upper(x)
        return ((~ux.contains(F.upper(doc_type))) & (x != F.lit(""))
                & (is_upper(x) | _any([ux.contains(w) for w in P.COMPANY_WORDS])))
    cand = F.filter(F.transform(F.split(text, "\n"), strip), ok)
    return F.coalesce(F.get(cand, 0), F.lit(""))


def simple_number(text: Column, label: str, low: Column | None = None) -> Column:
    """The first number after the first label."""
    rest = rest_from(fold(text) if low is None else low, folded(label))
    return number_loose(extract_folded(rest, rf"\A{label}{P.SIMPLE_NUMBER_TAIL}"))


def simple_total(text: Column, low: Column | None = None) -> Column:
    """Five decimal labels, five loose labels (first positive), then the
    words hint (constant for lakh/lac), else 0.0."""
    low = fold(text) if low is None else low
    vals = [number_loose(extract_folded(low, p)) for p in P.SIMPLE_TOTAL_DECIMAL + P.SIMPLE_TOTAL_LOOSE]
    words = F.lower(strip(extract(text, P.WORDS_HINT, "i")))
    hint = F.when(_any([words.contains(t) for t in P.WORDS_HINT_TOKENS]), F.lit(P.WORDS_HINT_VALUE))
    return F.coalesce(*[positive(v) for v in vals], hint, F.lit(0.0))


def simple_headers(docs: DataFrame, vendor_pattern: str = P.VENDOR_NUMBER,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    t, low = F.col("text"), F.col("_low")
    docs = docs.select("doc_key", "text", *[k for k in keep if k not in ("doc_key", "text")], fold(t).alias("_low"))
    a = docs.select(
        "doc_key", "text", "_low", *[k for k in keep if k != "text"],
        document_type(t).alias("document_type"),
        simple_invoice_number(t, vendor_pattern, low).alias("invoice_document_number"),
        simple_date(t).alias("invoice_document_date"),
        section(t, P.SUPPLIER_KEYWORDS, low).alias("_sec_s"),
        section(t, P.BUYER_KEYWORDS, low).alias("_sec_b"),
        section(t, P.CONSIGNEE_KEYWORDS, low).alias("_sec_c"),
        labelled_id(t, P.SUPPLIER_ID_LABELS, low).alias("_lab_s"),
        labelled_id(t, P.BUYER_ID_LABELS, low).alias("_lab_b"),
        simple_number(t, P.SIMPLE_TOTAL_QTY, low).alias("total_quantity"),
        simple_number(t, P.SIMPLE_SUBTOTAL, low).alias("subtotal_taxable_value"),
        *[simple_number(t, p, low).alias(k) for k, p in P.SIMPLE_TAXES.items()],
        simple_total(t, low).alias("total_invoice_value"),
        strip(extract_ci(t, low, P.IRN, "s")).alias("irn_no"),
        strip(extract_folded(low, P.EWAY)).alias("eway_bill_no"),
        first_nonblank(t, P.SIMPLE_WORDS, "is", low=low).alias("amount_in_words"),
    )
    # the searches below are for documents without a labelled id
    unlabelled = F.col("_lab_s").isNull() | F.col("_lab_b").isNull()
    a = a.select("*", F.when(unlabelled, tax_ids_all(t)).alias("_ids"), F.when(unlabelled, first_at(low, "gstin", "")).alias("_gst_at"),
                 F.when(unlabelled & has_any(low, ["GSTIN"]), id_after(t, "GSTIN", low)).alias("_gst_id"),
                 party_name_raw(F.col("_sec_s"), P.SUPPLIER_KEYWORDS).alias("_rn_s"),
                 party_name_raw(F.col("_sec_b"), P.BUYER_KEYWORDS).alias("_rn_b"),
                 party_name_raw(F.col("_sec_c"), P.CONSIGNEE_KEYWORDS).alias("_rn_c"))
    parties = {}
    for k in "sbc":
        sec, raw = F.col(f"_sec_{k}"), F.col(f"_rn_{k}")
        parties[k] = (party_name(sec, raw), party_address(sec, raw))
    sn, sa = parties["s"]
    bn, ba = parties["b"]
    cn, ca = parties["c"]
    gst = F.col("_ids"), F.col("_gst_at"), F.col("_gst_id"), low
    b = a.select(
        "*",
        sn.alias("_sn"), sa.alias("supplier_address"),
        bn.alias("_bn"), ba.alias("buyer_address"),
        cn.alias("_cn"), ca.alias("_ca"),
        simple_gstin(t, "supplier", *gst, F.col("_lab_s")).alias("supplier_gstin"),
        simple_gstin(t, "buyer", *gst, F.col("_lab_b")).alias("buyer_gstin"),
        simple_gstin(t, "consignee", *gst, F.col("_lab_b")).alias("_cg"),
    )
    # only looked for where the section has no name
    legal = strip(filled(extract_ci(t, low, P.LEGAL_NAME)))
    supplier_name = F.when(F.col("_sn") == "", company_name(t, F.col("document_type"))).otherwise(F.col("_sn"))
    buyer_name = F.when(F.col("_bn") == "", F.coalesce(legal, F.lit(""))).otherwise(F.col("_bn"))
    c = b.select(
        "*", supplier_name.alias("supplier_name"), buyer_name.alias("buyer_name"))
    blank_c = F.col("_cn") == ""
    d = c.select(
        "*",
        F.when(blank_c, F.col("buyer_name")).otherwise(F.col("_cn")).alias("consignee_name"),
        F.when(blank_c, F.col("buyer_address")).otherwise(F.col("_ca")).alias("consignee_address"),
        F.when(blank_c, F.col("buyer_gstin")).otherwise(F.col("_cg")).alias("consignee_gstin"),
        serial_number(F.col("doc_key")).alias("serial_number"),
    )
    return conform_headers(d, ("doc_key",) + tuple(keep))


# --- layout profile ------------------------------------------------------------------


def layout_invoice_number(text: Column, vendor_pattern: str = P.VENDOR_NUMBER, low: Column | None = None) -> Column:
    """H4: three colon-required labels (first match wins), then the
    case-sensitive vendor form, default ``""``."""
    low = fold(text) if low is None else low
    labelled = first_matching(text, P.LAYOUT_NUMBER, "i", default=F.lit(None).cast("string"), nonempty=True,
                              needs=[has_any(low, [w]) for w in P.LAYOUT_NUMBER_WORDS], low=low)
    return F.coalesce(labelled, filled(strip(extract(text, vendor_pattern, ""))), F.lit(""))


def layout_entity_name(text: Column, roles: list[str], low: Column | None = None) -> Column:
    """Value after ``role :`` up to newline / GSTIN / PAN, spaces collapsed."""
    low = fold(text) if low is None else low
    pats = [rf"{r}{P.ENTITY_TAIL}" for r in roles]
    needs = [has_any(low, [r]) & matches(low, rf"{folded(r)}\s*:") for r in roles]
    return first_matching(text, pats, "is", post=lambda x: collapse_ws(strip(x)), needs=needs)


def layout_gstin(text: Column, role: str, all_ids: Column, label_id: Column, low: Column | None = None) -> Column:
    """H9 in its intended form: first id after the first role word; else the
    first id after ``GSTIN`` (``label_id``); else the id nearest to the first role word (at any
    distance), ties to the earlier id."""
    words = P.LAYOUT_ID_ROLES[role]
    low = fold(text) if low is None else low
    anchor = F.regexp_instr(text, F.lit(py(f"(?:{words})")))
    best = F.array_min(F.transform(all_ids, lambda m, i: F.struct(
        F.abs(F.instr(text, m) - anchor).alias("d"), i.alias("i"), m.alias("m"))))
    nearest = F.when(anchor > 0, best["m"])
    return F.coalesce(F.when(has_any(low, words.split("|")), id_after(text, words, low)), label_id, nearest, F.lit(""))


def layout_address(text: Column, name: Column) -> Column:
    """From the first occurrence of the name onward, the first of four
    address patterns, else the lines that follow up to a blank line or a line
    with an id, phone or email label."""
    pos = F.instr(text, name)
    chunk = F.substring(text, pos, F.length(text))
    lines = F.split(chunk, "\n")
    after = F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))
    stop = _first_index(after, lambda x: (strip(x) == F.lit("")) | matches(x, P.ADDRESS_SKIP, "i"))
    taken = F.when(stop.isNull(), after).otherwise(F.slice(after, 1, stop))
    fb = F.array_join(F.transform(taken, strip), ", ")
    # from the first line end on: a later one has no other word or end after it, nor has a later word another end
    patterns = [P.ADDRESS_LABEL] + [rf"\A[^\n]*+\n((?>.*?{w}).*?){P.ADDRESS_END}" for w in P.ADDRESS_WORDS]
    found = first_matching(chunk, patterns, "is", default=fb, post=lambda x: collapse_ws(strip(x)))
    return F.when((name == F.lit("")) | (pos == 0), F.lit("")).otherwise(found)


def _layout_number(text: Column, labels: str, low: Column | None = None) -> Column:
    """H18/H19/H23 in the intended grouped form: first number after the label
    on the same line, optional ``Rs``/``INR``; commas dropped."""
    low = fold(text) if low is None else low
    if r"\s" in labels:  # may reach into the next line, so a later label of a line can have another end
        return number_strict(extract_folded(low, rf"{labels}{P.LAYOUT_NUMBER_TAIL}"))
    # from the first label on; a line's first label only: if no number follows it, none follows a later one
    rest = rest_from(low, folded(labels))
    return number_strict(extract_folded(rest, rf"(?m:^)(?>.*?(?={labels})){labels}{P.LAYOUT_NUMBER_TAIL}"))


def layout_amount_in_words(text: Column) -> Column:
    """Three alternatives (first match wins), spaces collapsed, `` Only`` appended if absent."""
    w = first_matching(text, P.LAYOUT_WORDS, "is", post=lambda x: collapse_ws(strip(x)),
                       default=F.lit(None).cast("string"))
    return F.when(w.isNull(), F.lit("")).when(F.lower(w).contains("only"), w) \
        .otherwise(F.concat(w, F.lit(" Only")))


def layout_headers(docs: DataFrame, vendor_pattern: str = P.VENDOR_NUMBER,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    t, low = F.col("text"), F.col("_low")
    ids = F.col("_ids"), F.col("_gst_id"), low
    docs = docs.select("doc_key", "text", *[k for k in keep if k not in ("doc_key", "text")], fold(t).alias("_low"))
    docs = docs.select("*", id_after(t, "GSTIN", low).alias("_gst_id"))
    # the ids by distance are for documents without a labelled one
    docs = docs.select("*", F.when(F.col("_gst_id").isNull(), tax_ids_all(t)).alias("_ids"))
    a = docs.select(
        "doc_key", "text", *[k for k in keep if k != "text"],
        document_type(t).alias("document_type"),
        layout_invoice_number(t, vendor_pattern, low).alias("invoice_document_number"),
        first_matching(t, P.LAYOUT_DATE, "i", nonempty=True).alias("invoice_document_date"),
        layout_entity_name(t, P.LAYOUT_SUPPLIER_ROLES, low).alias("supplier_name"),
        layout_entity_name(t, P.LAYOUT_BUYER_ROLES, low).alias("buyer_name"),
        layout_entity_name(t, P.LAYOUT_CONSIGNEE_ROLES, low).alias("_cn"),
        layout_gstin(t, "supplier", *ids).alias("supplier_gstin"),
        layout_gstin(t, "buyer", *ids).alias("buyer_gstin"),
        layout_gstin(t, "consignee", *ids).alias("_cg"),
        _layout_number(t, P.LAYOUT_TOTAL_QTY, low).alias("total_quantity"),
        F.bround(_layout_number(t, P.LAYOUT_SUBTOTAL, low), 2).alias("subtotal_taxable_value"),
        *[F.bround(_layout_number(t, lab, low), 2).alias(k) for k, lab in P.LAYOUT_TAX_LABELS.items()],
        F.bround(_layout_number(t, P.LAYOUT_TOTAL, low), 2).alias("total_invoice_value"),
        layout_amount_in_words(t).alias("amount_in_words"),
        first_value(t, P.LAYOUT_IRN, "").alias("irn_no"),
        strip(extract_folded(low, P.EWAY)).alias("eway_bill_no"),
    )
    b = a.select(
        "*",
        F.when(F.col("_cn") == "", F.col("buyer_name")).otherwise(F.col("_cn")).alias("consignee_name"),
        F.when(F.col("_cg") == "", F.col("buyer_gstin")).otherwise(F.col("_cg")).alias("consignee_gstin"),
        layout_address(t, F.col("supplier_name")).alias("supplier_address"),
        layout_address(t, F.col("buyer_name")).alias("buyer_address"),
        serial_number(F.col("doc_key")).alias("serial_number"),
    )
    c = b.select("*", layout_address(t, F.col("consignee_name")).alias("_ca"))
    d = c.select("*", F.when(F.col("_ca") == "", F.col("buyer_address")).otherwise(F.col("_ca"))
                 .alias("consignee_address"))
    return conform_headers(d, ("doc_key",) + tuple(keep))


# --- minimal profile -------------------------------------------------------------------


def minimal_supplier_name(text: Column) -> Column:
    """First line that is non-blank and lacks ``invoice`` (only when the
    text has at least 2 lines)."""
    lines = F.split(text, "\n")
    cand = F.filter(lines,
                    lambda x: (strip(x) != F.lit("")) & ~F.lower(x).contains("invoice"))
    return F.when(F.size(lines) > 1, F.coalesce(strip(F.get(cand, 0)), F.lit(""))).otherwise(F.lit(""))


def known_party_line(text: Column, parties: list[str]) -> Column:
    """The first listed party name found in the text (ignore case) -> the
    stripped line of its first occurrence; NULL when none is found.

    The dictionary is a fixed list compiled into the projection, so no join
    (containment is not an equality) and no broadcast is needed; every name is
    checked, in order, for every document.
    """
    lines = F.split(text, "\n")
    low = F.lower(text)
    out = F.lit(None).cast("string")
    def has(n):
        return lambda x: F.lower(x).contains(n.lower())
    for name in reversed(parties):
        line = F.get(F.filter(lines, has(name)), 0)
        out = F.when(low.contains(name.lower()), strip(line)).otherwise(out)
    return out


def minimal_fields(text: Column, provider: Column, parties=P.KNOWN_PARTIES,
                   full_party=P.KNOWN_PARTY_FULL, address_anchor=P.KNOWN_ADDRESS,
                   vendor_pattern: str = P.VENDOR_NUMBER) -> dict[str, Column]:
    """The 12-field fallback record as a dict of columns."""
    buyer = first_matching(text, P.MINIMAL_BUYER, "i", nonempty=True)
    legal = F.when(matches(text, P.LEGAL_NAME, "i"), strip(extract(text, P.LEGAL_NAME, "i")))
    buyer = F.coalesce(legal, buyer)
    party = known_party_line(text, parties)
    buyer = F.when(party.isNotNull() & (party != ""), party).otherwise(buyer)
    full = F.when(matches(text, full_party, "i"), strip(extract(text, full_party, "i")))
    buyer = F.coalesce(full, buyer)
    ids = tax_ids_all(text)
    addr = F.when(matches(text, address_anchor, ""),
                  strip(F.regexp_replace(extract(text, address_anchor, ""), "\n", " ")))
    total = first_matching(text, P.MINIMAL_TOTAL, "i", post=lambda x: number_strict(x),
                           default=F.lit(0.0), nonempty=True)
    numbers = P.MINIMAL_NUMBER[:-1] + [vendor_pattern]
    return {
        "document_type": document_type(text, P.DOC_TYPES_MINIMAL),
        "invoice_document_number": first_matching(text, numbers, "i", nonempty=True),
        "invoice_document_date": first_matching(text, P.MINIMAL_DATE, "i", nonempty=True),
        "supplier_name": minimal_supplier_name(text),
        "buyer_name": buyer,
        "supplier_gstin": F.coalesce(F.get(ids, 0), F.lit("")),
        "buyer_gstin": F.coalesce(F.get(ids, 1), F.lit("")),
        "supplier_address": F.coalesce(addr, F.lit("")),
        "total_invoice_value": total,
        "additional_remarks": F.concat(F.lit("Extracted with fallback method due to "),
                                       F.initcap(provider), F.lit(" API failure")),
    }


def minimal_headers(docs: DataFrame, provider: str | Column = "google", keep: tuple[str, ...] = (),
                    **kw) -> DataFrame:
    prov = provider if isinstance(provider, Column) else F.lit(provider)
    if isinstance(provider, str) and "provider" in docs.columns:
        prov = F.col("provider")
    fields = minimal_fields(F.col("text"), prov, **kw)
    d = docs.select("doc_key", *keep, serial_number(F.col("doc_key")).alias("serial_number"),
                    *[c.alias(k) for k, c in fields.items()])
    return conform_headers(d, ("doc_key",) + tuple(keep))


def extract_headers(docs: DataFrame, profile: str = "simple", **kw) -> DataFrame:
    """``(doc_key, text)`` -> ``doc_key`` + 30 header fields."""
    if profile == "simple":
        return simple_headers(docs, **kw)
    if profile == "layout":
        return layout_headers(docs, **kw)
    if profile == "minimal":
        return minimal_headers(docs, **kw)
    raise ValueError(f"unknown profile {profile!r}; expected one of {PROFILES}")
