"""Queries of the functions on markup, single values and signals, and of small comparisons, over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsift.functions import binary, markup, values
from plainsift.operators import matching, reporting
from plainsift.shared import current_rows, table
from plainsift.sources import files


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumns({"k": F.coalesce("doc_kind", F.lit("")), "s": F.coalesce("source", F.lit("")), "t": F.coalesce("text", F.lit(""))})


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def _said(*pieces: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def _pick(number: str, *choices: str | Column) -> Column:
    """One of the choices, by a number."""
    at = F.pmod(F.col(number), F.lit(len(choices)))
    chain = F.lit(None).cast("string")
    for n, choice in enumerate(choices):
        chain = F.when(at == n, F.lit(choice) if isinstance(choice, str) else choice).otherwise(chain)
    return chain


def _escaped(col: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(sign), F.lit(name))
    return col


def doctypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts declare a document type before their root."""
    part = _pick("doc_id", _said("<?xml version=\"1.0\"?>\n<!-- <a> -->\n<!DOCTYPE a><a>", _escaped(F.col("t")), "</a>"), _said("<a>", F.col("k"), "</a><!DOCTYPE b>"), _said("<!-- <!DOCTYPE x> --><a>", F.col("s"), "</a>"), _said("<!DOCTYPE ", F.col("k"), ">"))
    return _docs(spark, sf_dir).select("doc_id", markup.has_doctype(part).alias("declared"))


def markup_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How parts spell their declaration and their empty elements."""
    head = _pick("doc_id", "<?xml version=\"1.0\"?>", "<?xml version='1.0'?>\r\n", "")
    part = F.concat(head, F.lit("<a>"), F.repeat(F.lit("<b />"), F.pmod("doc_id", F.lit(4)).cast("int")), F.col("k"), F.repeat(F.lit("<c/>"), F.pmod("doc_id", F.lit(3)).cast("int")), F.lit("</a>"))
    return _docs(spark, sf_dir).select("doc_id", markup.declaration(part).alias("declaration"), markup.self_closing(part).alias("empty"))


def package_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each supplier's lines, taken as the members of a package, are ordered and timed."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_extendedprice")
    members = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"))).alias("m"))
    names = F.transform("m", lambda x: F.when((F.pmod("l_orderkey", F.lit(3)) == 0) & (x["l_linenumber"] == 1), "[Content_Types].xml").otherwise(x["l_returnflag"]))
    stamps = F.transform("m", lambda x: F.when(F.pmod("l_orderkey", F.lit(4)) == 0, F.array(F.lit(33), F.lit(0))).when(F.pmod("l_orderkey", F.lit(4)) == 1, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(40), x["l_linenumber"].cast("int"))))
    return members.select("l_orderkey", markup.order_policy(names).alias("policy"), markup.time_scheme(stamps).alias("times"))


def nested_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested elements unwrapped, removed, and removed where their opening tag says so."""
    part = _said('<a><w:ins by="', F.col("k"), '"><w:ins by="x > y"><t>', _escaped(F.col("t")), "</t></w:ins><w:ins/></w:ins><w:insert>", F.col("s"), "</w:insert></a>")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(markup.unwrap_elements(part, "w:ins"), 256).alias("unwrapped"), F.sha2(markup.remove_elements(part, "w:ins"), 256).alias("removed"), F.sha2(markup.remove_elements(part, "w:ins", 'by="x'), 256).alias("some_removed"))


def visible_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of each document, as a word processor's part and as a page."""
    part = _said('<w:p><w:r><w:rPr/><w:t xml:space="preserve">', _escaped(F.col("t")), "</w:t><w:tab/><w:t>", _escaped(F.col("k")), "</w:t><w:br/><w:instrText>x</w:instrText></w:r></w:p>")
    page = _said("<html><head><title>no</title></head><body><!-- ", F.col("k"), " --><script>var a = '<b>';</script><p>", _escaped(F.col("k")), "</p><p class=\"x\">", _escaped(F.col("s")), " &amp; end</p></body></html>")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(markup.document_text(part), 256).alias("document"), markup.page_text(page).alias("page"))


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a sheet: a row per line, hidden where it was returned, with a column for each and a footer."""
    row = _said("<row r=\"1\"", F.when(F.col("l_returnflag") == "R", ' hidden="1"').otherwise(""), "><c r=\"A", F.col("l_linenumber").cast("string"), "\" t=\"n\"><v>", F.col("l_partkey").cast("string"), "</v></c></row>", F.when(F.col("l_linestatus") == "F", '<col min="1" hidden="true"/>').otherwise('<col hidden="0"/>'))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", row.alias("x")).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "x"))), lambda r: r["x"]), "").alias("rows"))
    return lines.select("l_orderkey", F.concat(F.lit("<sheetData>"), "rows", F.lit("</sheetData><oddFooter> </oddFooter><evenHeader>&amp;P</evenHeader>")).alias("part"))


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of every order's sheet."""
    cells = _sheets(spark, sf_dir).select("l_orderkey", F.explode(markup.sheet_cells(F.col("part"))).alias("c"))
    return cells.select("l_orderkey", "c.ref", "c.type", "c.value")


def hidden_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden rows, hidden columns and headers with text of every order's sheet."""
    return _sheets(spark, sf_dir).select("l_orderkey", markup.hidden_counts(F.col("part")).alias("h")).select("l_orderkey", F.col("h.rows").alias("n_rows"), F.col("h.columns").alias("n_columns"), F.col("h.headers").alias("n_headers"))


def clean_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without what their heads say about their makers."""
    page = _said(
        '<html><head><meta charset="utf-8"/><meta name="author" content="', F.col("s"), '"/><META property="og:x" content="y"><meta name="viewport" content="w"/><link rel="author me" href="', F.col("s"), '"/><link rel="icon" href="', F.col("k"),
        '"/></head><body><svg><metadata id="m"><a>', F.col("s"), "</a></metadata><rect/></svg><p>", F.col("k"), "</p></body></html>",
    )
    return _docs(spark, sf_dir).select("doc_id", markup.clean_head(page).alias("page"))


def metadata_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of children of a book's metadata, one of ten kinds for every customer."""
    n = "c_custkey"
    space = F.when(F.pmod(n, F.lit(10)) < 4, markup.DUBLIN_CORE).when(F.pmod(n, F.lit(10)) < 9, markup.BOOK).otherwise("urn:other")
    name = _pick(n, "identifier", "identifier", "title", "creator", "meta", "meta", "meta", "meta", "meta", "meta")
    id_ = _pick(n, "uid", "old", "t1", "c1", "", "", "", "", "", "")
    pair = lambda **kv: F.create_map(*[F.lit(x) for k, v in kv.items() for x in (k, v)])
    attributes = [pair(x="y")] * 4 + [pair(property="dcterms:modified"), pair(name="cover"), pair(property="title-type", refines="#t1"), pair(property="role", refines="#c1"), pair(property="rendition:layout"), pair(property="dcterms:modified")]
    chosen = F.element_at(F.array(*attributes), (F.pmod(n, F.lit(10)) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(n, markup.metadata_verdict(space, name, id_, chosen, F.lit("uid"), F.array(F.lit("t1"))).alias("verdict"))


def blanked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures whose names are files or paths, without them."""
    part = _said('<pic:cNvPr id="1" name="', F.col("p_name"), '.PNG" descr="', F.col("p_type"), '"/><wp:docPr name="Picture ', F.col("p_size").cast("string"), '" title="C:\\Users\\', F.col("p_brand"), '"/><v:imagedata o:title="', F.col("p_brand"), '"/><w:t name="a.png"/>')
    return _parts(spark, sf_dir).select("p_partkey", markup.blank_picture_names(part).alias("part"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places that texts made of orders name."""
    place = _said("at +", F.lpad(F.pmod("o_orderkey", F.lit(90)).cast("string"), 2, "0"), ".", F.lpad(F.pmod("o_custkey", F.lit(1000)).cast("string"), 3, "0"), "-", F.lpad(F.pmod("o_custkey", F.lit(180)).cast("string"), 3, "0"), ".5000/ and +1.2-3.4, ", F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(markup.coordinates(place), "|").alias("found"))


def standard_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether profiles described by parts are published ones."""
    described = _pick("p_partkey", _said("sRGB ", F.col("p_brand")), _said(F.col("p_brand"), " sRGB"), "P3", "P3x", _said("  Adobe RGB (1998)", F.col("p_brand")), "Adobe RGB (1998), ", F.col("p_name"))
    return _parts(spark, sf_dir).select("p_partkey", markup.standard_profile(described).alias("standard"))


def canonical_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of customers in one spelling."""
    part = _said("<b:x xmlns:b='u:", F.col("c_mktsegment"), "' xmlns:un=\"used:not\"  z = '2' a=\"1\"><!-- made --><b:y /><z>", F.col("c_name"), "</z></b:x >")
    return table(spark, sf_dir, "customer").select("c_custkey", markup.canonical(part).alias("part"))


def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of pictures made of orders, as text: two numbers, a text, and three ratios."""
    number = lambda c, width: F.unhex(F.lpad(F.hex(c), 2 * width, "0"))
    degrees = [F.pmod("o_orderkey", F.lit(90)), F.lit(1), F.pmod("o_custkey", F.lit(60)), F.lit(1), F.pmod("o_custkey", F.lit(6000)), F.lit(100)]
    raws = [F.concat(number(F.pmod("o_custkey", F.lit(65536)), 2), number(F.lit(7), 2)), F.concat(F.encode("o_orderpriority", "utf-8"), F.lit(b"\0junk")), F.concat(*[number(d, 4) for d in degrees])]
    at = F.pmod("o_orderkey", F.lit(3))
    by = lambda a, b, c: F.when(at == 0, a).when(at == 1, b).otherwise(c)
    value = values.field_value(by(*raws), by(F.lit(3), F.lit(2), F.lit(5)), by(F.lit(2), F.octet_length(raws[1]), F.lit(3)), F.lit(False))
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"))


def page_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, strings and names of a page description in one spelling."""
    return _parts(spark, sf_dir).select(
        "p_partkey",
        values.page_number(F.col("p_retailprice").cast("decimal(18,4)") - F.col("p_size")).alias("number"),
        values.page_string(F.encode(_said(F.col("p_name"), _pick("p_partkey", "(\\)", "é", "")), "utf-8")).alias("string"),
        values.page_name(F.concat(F.lit("/#41"), F.col("p_type"))).alias("name"),
    )


def hidden_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts hidden as a book's fonts are: freed again they are the same, and what lies behind the hidden bytes never changes."""
    key = values.font_key(_said("urn:x:", F.col("s"), " \n", F.col("k")), "idpf")
    docs = _docs(spark, sf_dir).where("octet_length(encode(t, 'utf-8')) > 1100").select("doc_id", F.encode("t", "utf-8").alias("font"), key.alias("key"))
    hidden = docs.withColumn("hidden", values.hidden_font(F.col("font"), F.col("key"), "idpf"))
    freed = values.hidden_font(F.col("hidden"), F.col("key"), "idpf")
    return hidden.select("doc_id", F.sha2(freed, 256).alias("freed"), (F.col("hidden") == F.col("font")).alias("same"), F.sha2(F.substr("hidden", F.lit(1041)), 256).alias("rest"))


def blanked_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with every copy of their format and kind as zeros, the longer first."""
    wanted = F.array(F.encode("about_format", "utf-8"), F.encode("k", "utf-8"), F.encode(F.lit("the"), "utf-8"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(values.blank_copies(F.encode("t", "utf-8"), wanted), 256).alias("digest"))


def told_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of ten to the sixth and ninth, times, colours of shares, and badges."""
    parts = _parts(spark, sf_dir)
    return parts.select("p_partkey", values.decimal_size(F.col("p_partkey") * 1234567).alias("size"), values.seconds(F.col("p_size") * 3.5).alias("time"), values.share_colour(F.col("p_size") * 2).alias("colour"), values.badge_text(F.concat_ws("-", "p_brand", "p_type")).alias("badge"))


def best_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a series made for every vector and the same one 50 samples later, the lag at which they agree, and how well."""
    noise = lambda n, off: F.transform(F.sequence(F.lit(off), F.lit(off + n - 1)), lambda i: F.pmod((i * i * 7919 + i * 31 + F.col("vec_id")) * 40503, F.lit(65536)).cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", binary.best_lag(noise(400, 0), noise(400, 50)).alias("b"))
    return rows.select("vec_id", F.col("b.lag").alias("lag"), F.round("b.correlation", 6).alias("correlation"))


def copy_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marks (format, adversary, verdict) that the two copies of the cells don't hold equally often."""
    copies = [current_rows(table(spark, sf_dir, f"cells_{c}"), "cell_id", ["loaded_at"], ["cell_id", "format", "adversary", "verdict"]) for c in ("published", "measured")]
    return matching.multiset_diff(*copies, ["format", "adversary", "verdict"])


def stream_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices whose cells, in their order, don't have equal verdicts in both copies."""
    copies = [current_rows(table(spark, sf_dir, f"cells_{c}"), "cell_id", ["loaded_at"], ["cell_id", "matrix_id", "verdict"]) for c in ("published", "measured")]
    return matching.sequence_diff(*copies, "matrix_id", "cell_id", "verdict")


def rate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier and return flag, the line numbers that occur, and how often."""
    return reporting.rate_report(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", "l_linenumber")


def sampled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of each kind, the same in every run; a sample is what this operator is for."""
    docs = table(spark, sf_dir, "documents").where("doc_kind is not null")
    return matching.sample_of_each(docs.select("doc_id", "doc_kind"), "doc_kind", "doc_id", 5)


def discovered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that files of the sheet give by a rule of names, with the last path of each."""
    return files.discovered(table(spark, sf_dir, "scrub_results").select("path"), "path", r"^([a-z]+)_.*\.[a-z0-9]+$", {"README.md": "read me"})


def breadth_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts reached from part 1 along number, third of a number, numbered breadth first."""
    parts = _parts(spark, sf_dir)
    edges = parts.where("p_partkey > 1").select(F.expr("(p_partkey + 1) div 3").alias("src"), F.col("p_partkey").alias("dst"))
    return matching.numbered_breadth_first(edges, parts.where("p_partkey = 1").select(F.col("p_partkey").alias("node")))


QUERIES = {
    f.__name__: f
    for f in (
        doctypes, markup_shapes, package_shapes, nested_elements, visible_texts, sheet_cells, hidden_counts, clean_heads, metadata_verdicts, blanked_names, coordinates, standard_profiles, canonical_parts, field_values, page_spellings, hidden_fonts,
        blanked_copies, told_numbers, best_lags, copy_differences, stream_differences, rate_report, sampled_files, discovered_names, breadth_numbers,
    )
}

_D = "with d as (select doc_id, coalesce(doc_kind, '') k, coalesce(source, '') s, coalesce(text, '') t, about_format from documents) "
_ESC = "replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_STATE = "(select * from cells_{} qualify row_number() over (partition by cell_id order by loaded_at desc nulls last) = 1)"
_LINES = "with m as (select l_orderkey k, list(struct_pack(n := l_linenumber, f := l_returnflag) order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) m from lineitem group by 1), n as (select k, list_transform(m, lambda x: case when k % 3 = 0 and x.n = 1 then '[Content_Types].xml' else x.f end) names, len(list_distinct(list_transform(m, lambda x: x.n))) times from m) "
SQL = {
    "doctypes": _D + "select doc_id, doc_id % 4 in (0, 3) declared from d",
    "markup_shapes": "select doc_id, case doc_id % 3 when 0 then '<?xml version=\"1.0\"?>' when 1 then '<?xml version=''1.0''?>' || chr(13) || chr(10) else '' end as declaration, case when doc_id % 4 = 0 and doc_id % 3 = 0 then 'none' when doc_id % 4 = 0 then 'tight' when doc_id % 3 = 0 then 'spaced' else 'mixed' end empty from documents",
    "package_shapes": _LINES + "select k l_orderkey, case when names[1] = '[Content_Types].xml' and names[2:] = list_sort(names[2:]) then 'types first, then sorted' when names = list_sort(names) then 'sorted' when names[-1] = '[Content_Types].xml' then 'types last' when names[1] = '[Content_Types].xml' then 'types first' else 'own order' end policy, "
    "case k % 4 when 0 then 'first day' when 1 then 'unset' else 'clock, ' || times || ' times' end times from n",
    "nested_elements": _D + f"select doc_id, sha256('<a><t>' || {_ESC} || '</t><w:insert>' || s || '</w:insert></a>') unwrapped, sha256('<a><w:insert>' || s || '</w:insert></a>') removed, sha256('<a><w:ins by=\"' || k || '\"><w:ins/></w:ins><w:insert>' || s || '</w:insert></a>') some_removed from d",
    "visible_texts": _D + "select doc_id, sha256(t || chr(9) || k || chr(10)) document, trim(regexp_replace(k || ' ' || s || ' & end', '\\s+', ' ', 'g')) page from d",
    "sheet_cells": "select l_orderkey, 'A' || l_linenumber ref, 'n' as type, cast(l_partkey as varchar) as value from lineitem",
    "hidden_counts": "select l_orderkey, cast(count(*) filter (where l_returnflag = 'R') as int) n_rows, cast(count(*) filter (where l_linestatus = 'F') as int) n_columns, 1 n_headers from lineitem group by 1",
    "clean_heads": _D + "select doc_id, '<html><head><meta charset=\"utf-8\"/><meta name=\"viewport\" content=\"w\"/><link rel=\"icon\" href=\"' || k || '\"/></head><body><svg><rect/></svg><p>' || k || '</p></body></html>' page from d",
    "metadata_verdicts": "select c_custkey, ['identifier', 'drop', 'keep', 'drop', 'modified', 'keep', 'keep', 'drop', 'keep', 'drop'][c_custkey % 10 + 1] verdict from customer",
    "blanked_names": "select p_partkey, '<pic:cNvPr id=\"1\" name=\"\" descr=\"' || p_type || '\"/><wp:docPr name=\"Picture ' || p_size || '\" title=\"\"/><v:imagedata o:title=\"\"/><w:t name=\"a.png\"/>' part from part",
    "coordinates": "select o_orderkey, printf('+%02d.%03d-%03d.5000', o_orderkey % 90, o_custkey % 1000, o_custkey % 180) found from orders",
    "standard_profiles": "select p_partkey, p_partkey % 7 in (0, 2, 5) standard from part",
    "canonical_parts": "select c_custkey, '<?xml version=\"1.0\" encoding=\"UTF-8\" standalone=\"yes\"?>' || chr(10) || '<ns0:x xmlns:ns0=\"u:' || c_mktsegment || '\" a=\"1\" z=\"2\"><ns0:y/><z>' || c_name || '</z></ns0:x>' part from customer",
    "field_values": "select o_orderkey, case o_orderkey % 3 when 0 then (o_custkey % 65536) || ', 7' when 1 then o_orderpriority else (o_orderkey % 90) || '° ' || (o_custkey % 60) || ''' ' || printf('%.2f', (o_custkey % 6000) / 100.0) || '\"' end as value from orders",
    "page_spellings": "with p as (select *, p_name || ['(\\)', 'é', ''][p_partkey % 3 + 1] s, cast(cast(p_retailprice as decimal(18,4)) - p_size as decimal(18,4)) n from part) select p_partkey, case when n = 0 then '0' else rtrim(rtrim(cast(n as varchar), '0'), '.') end number, case when p_partkey % 3 = 1 then '<' || hex(encode(s)) || '>' else '(' || replace(replace(replace(s, '\\', '\\\\'), '(', '\\('), ')', '\\)') || ')' end string, '/A' || replace(p_type, ' ', '#20') as name from p",
    "hidden_fonts": _D + "select doc_id, sha256(t) freed, false same, sha256(unhex(substring(hex(encode(t)), 2081))) rest from d where octet_length(encode(t)) > 1100",
    "blanked_copies": _D + ", w as (select doc_id, t, list_sort(list_distinct(list_filter([about_format, k, 'the'], lambda x: x <> ''))) w from d) select doc_id, sha256(replace(replace(replace(t, a, repeat(chr(0), strlen(a))), b, repeat(chr(0), strlen(b))), c, repeat(chr(0), strlen(c)))) digest from (select doc_id, t, coalesce(o[1].x, '|none|') a, coalesce(o[2].x, '|none|') b, coalesce(o[3].x, '|none|') c from (select doc_id, t, list_sort(list_transform(w, lambda x: struct_pack(n := -strlen(x), x := x))) o from w))",
    "told_numbers": "with p as (select *, p_partkey * 1234567 b, p_size * 3.5 s from part) select p_partkey, case when b >= 1000000000 then cast(round(b / 1e9, 1) as decimal(20,1)) || ' GB' else cast(round(b / 1e6, 1) as decimal(20,1)) || ' MB' end size, case when s < 60 then cast(round(s, 1) as decimal(20,1)) || ' s' else (cast(round(s) as bigint) // 60) || ' min ' || lpad(cast(cast(round(s) as bigint) % 60 as varchar), 2, '0') || ' s' end as time, case when p_size >= 45 then 'brightgreen' when p_size * 2 >= 75 then 'green' when p_size >= 30 then 'yellow' when p_size >= 20 then 'orange' else 'red' end colour, replace(replace(replace(p_brand || '-' || p_type, '-', '--'), '_', '__'), ' ', '_') badge from p",
    "best_lags": "select vec_id, 50 lag, 1.0::double correlation from embeddings",
    "copy_differences": f"with p as (select format, adversary, verdict, count(*) n from {_STATE.format('published')} group by 1, 2, 3), m as (select format, adversary, verdict, count(*) n from {_STATE.format('measured')} group by 1, 2, 3) select coalesce(p.format, m.format) format, coalesce(p.adversary, m.adversary) adversary, coalesce(p.verdict, m.verdict) verdict, coalesce(p.n, 0) n_left, coalesce(m.n, 0) n_right from p full join m on p.format is not distinct from m.format and p.adversary is not distinct from m.adversary and p.verdict is not distinct from m.verdict where coalesce(p.n, 0) <> coalesce(m.n, 0)",
    "stream_differences": f"select coalesce(p.matrix_id, m.matrix_id) matrix_id, count(*) n_wrong, min(coalesce(p.cell_id, m.cell_id)) first_wrong from {_STATE.format('published')} p full join {_STATE.format('measured')} m on p.cell_id = m.cell_id and p.matrix_id = m.matrix_id where p.cell_id is null or m.cell_id is null or p.verdict is distinct from m.verdict group by 1",
    "rate_report": "with c as (select l_suppkey, l_returnflag, l_linenumber v, count(*) n from lineitem group by 1, 2, 3) select l_suppkey, l_returnflag, cast(sum(n) as bigint) n, string_agg(v, ' ' order by v) as values, string_agg(v || ':' || n, ' ' order by v) histogram from c group by 1, 2",
    "sampled_files": "select doc_id, doc_kind from documents where doc_kind is not null qualify row_number() over (partition by doc_kind order by sha256('7/' || doc_id), doc_id) <= 5",
    "discovered_names": "select regexp_extract(path, '(?:^|/)([a-z]+)_[^/]*\\.[a-z0-9]+$', 1) as name, max(path) path from scrub_results where regexp_extract(path, '(?:^|/)([a-z]+)_[^/]*\\.[a-z0-9]+$', 1) <> '' group by 1 union all select 'read me', max(path) from scrub_results where path = 'README.md' or path like '%/README.md' having max(path) is not null",
    "breadth_numbers": "with recursive r(node, depth) as (select p_partkey, 0 from part where p_partkey = 1 union all select p_partkey, depth + 1 from r join part on (p_partkey + 1) // 3 = node and p_partkey > 1) select node, depth, row_number() over (order by depth, node) number from r",
}
