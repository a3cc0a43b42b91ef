"""Queries over single rows: arithmetic, truth, texts, lists, ranges, maps and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lists, strings, values
from ..operators import sheet
from ..sources import sheets
from ..sources.folders import scratch


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def c(name: str):
    return F.col(name)


def int_math(spark, d):
    own, n = load(spark, d, "lineitem"), c("l_linenumber").cast("bigint")
    a = c("l_orderkey") - 3000
    return own.select("l_orderkey", "l_partkey", "l_suppkey", n.alias("l_linenumber"), values.int_div(a, n).alias("quotient"), values.int_mod(a, n).alias("remainder"), values.int_pow(n, F.lit(3)).alias("cube"), (-values.int_pow(n, F.lit(2))).alias("minus_square"))


INT_MATH = """select l_orderkey, l_partkey, l_suppkey, l_linenumber::bigint l_linenumber, ((l_orderkey - 3000) // l_linenumber)::bigint quotient, ((l_orderkey - 3000) % l_linenumber)::bigint remainder,
(l_linenumber::bigint * l_linenumber * l_linenumber)::bigint cube, (-(l_linenumber::bigint * l_linenumber))::bigint minus_square from lineitem"""


def float_mod(spark, d):
    own = load(spark, d, "lineitem")
    return own.select("l_orderkey", "l_partkey", "l_linenumber", values.int_mod(c("l_quantity") + 0.75, F.lit(4)).alias("m"), (values.float_div(c("l_quantity"), c("l_discount") * 0) == float("inf")).alias("is_inf"))


FLOAT_MOD = "select l_orderkey, l_partkey, l_linenumber, (trunc(l_quantity + 0.75)::bigint % 4)::bigint m, l_quantity > 0 is_inf from lineitem"


def float_text(spark, d):
    own = load(spark, d, "part")
    return own.select("p_partkey", values.float_text(c("p_size").cast("double") / 4).alias("quarter"), values.float_text(c("p_size").cast("double") * 1000000).alias("millions"), values.float_text(-(c("p_size").cast("double") / 1048576)).alias("tiny"))


FLOAT_TEXT = """with x as (select p_partkey, p_size, p_size * 1000000 m, printf('%.16e', -(p_size / 1048576.0)) e, p_size::double / 4 q from part)
select p_partkey, case when q = trunc(q) then q::bigint::varchar else q::varchar end "quarter",
case when m = 0 then '0' else regexp_replace(rtrim(rtrim(left(m::varchar, 1) || '.' || substr(m::varchar, 2), '0'), '.') || 'e+0' || (length(m::varchar) - 1), 'e\\+0(\\d\\d)', 'e+\\1') end millions,
case when p_size = 0 then '0' when p_size / 1048576.0 >= 0.0001 then '-' || (p_size / 1048576.0)::varchar else regexp_replace((-(p_size / 1048576.0))::varchar, 'e-(\\d)$', 'e-0\\1') end tiny from x"""


def truthiness(spark, d):
    own = load(spark, d, "orders")
    flag = F.when(c("o_orderstatus") == "F", "").otherwise(c("o_orderstatus"))
    return own.select(
        "o_orderkey", values.truthy(flag, "string").alias("text_true"), values.truthy(c("o_orderkey") % 4, "bigint").alias("number_true"), values.truthy(F.lit("0"), "string").alias("zero_text"),
        (values.truthy(flag) & ~values.truthy(c("o_orderkey") % 2, "bigint")).alias("both"), values.truthy(F.lit(None).cast("string")).alias("unset_true"))


TRUTHINESS = "select o_orderkey, o_orderstatus <> 'F' text_true, o_orderkey % 4 <> 0 number_true, true zero_text, o_orderstatus <> 'F' and o_orderkey % 2 = 0 \"both\", false unset_true from orders"


def coerced_eq(spark, d):
    own = load(spark, d, "customer")
    key, txt = c("c_custkey"), c("c_custkey").cast("string")
    return own.select("c_custkey", values.same(key, "bigint", txt, "string").alias("int_text"), values.same(key, "bigint", key.cast("double"), "double").alias("int_float"), values.same(F.array(key, key), "array<bigint>", F.concat_ws(" ", txt, txt), "string").alias("list_text"), values.same(F.lit(None).cast("string"), "string", F.lit(""), "string").alias("unset_empty"), values.to_int(c("c_acctbal"), "double").alias("whole"))


COERCED_EQ = "select c_custkey, true int_text, true int_float, true list_text, true unset_empty, trunc(c_acctbal)::bigint whole from customer"


def default_value(spark, d):
    own = load(spark, d, "part")
    maybe = F.when(c("p_size") % 3 != 0, c("p_name"))
    return own.select("p_partkey", values.default(maybe, F.lit("none")).alias("with_default"), values.choose(c("p_size") > 25, F.lit("large")).alias("choice"), values.choose(c("p_size") > 40, F.lit("huge"), F.when(c("p_size") > 10, "middle").otherwise("small")).alias("nested"), strings.template("[", maybe, "]").alias("optional"), values.required(c("p_name"), "p_name").alias("required"))


DEFAULT_VALUE = """select p_partkey, case when p_size % 3 <> 0 then p_name else 'none' end with_default, case when p_size > 25 then 'large' else '' end choice,
case when p_size > 40 then 'huge' when p_size > 10 then 'middle' else 'small' end nested, '[' || case when p_size % 3 <> 0 then p_name else '' end || ']' optional, p_name required from part"""


def numeric_filter(spark, d):
    return load(spark, d, "lineitem").where((c("l_quantity") >= 10) & (c("l_quantity") < 20) & (c("l_discount") > 0.05) & ~(c("l_returnflag") == "R")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", c("l_quantity").cast("bigint").alias("qty"))


NUMERIC_FILTER = "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::bigint qty from lineitem where l_quantity >= 10 and l_quantity < 20 and l_discount > 0.05 and l_returnflag <> 'R'"


def string_case_len(spark, d):
    own = load(spark, d, "part").select(c("p_partkey").alias("id"), c("p_name").alias("s")).union(load(spark, d, "nation").select(c("n_nationkey").cast("bigint"), "n_name"))
    own = own.withColumn("s", F.concat(c("s"), F.lit(" é")))
    return own.select("id", F.upper("s").alias("up"), F.lower("s").alias("low"), strings.byte_length(c("s")).cast("bigint").alias("bytes"), F.length("s").cast("bigint").alias("characters"), strings.char_at(c("s"), -1).alias("last"), F.repeat("s", F.lit(2)).alias("twice"))


STRING_CASE_LEN = """with x as (select p_partkey id, p_name || ' é' s from part union all select n_nationkey::bigint, n_name || ' é' from nation)
select id, upper(s) up, lower(s) low, strlen(s)::bigint bytes, length(s)::bigint characters, right(s, 1) "last", s || s twice from x"""


def path_parts(spark, d):
    p = F.regexp_extract("url", r"^[a-z]+:/(/[^?#]*)", 1)
    return load(spark, d, "pages").select("page_id", strings.basename(p).alias("base"), strings.dirname(p).alias("folder"), strings.abspath(F.concat(F.lit("a/../b/./"), F.lit("x")), "/data").alias("absolute"))


PATH_PARTS = """with x as (select page_id, regexp_extract(url, '^[a-z]+:/(/[^?#]*)', 1) p from pages)
select page_id, regexp_extract(rtrim(p, '/'), '([^/]*)$', 1) base, regexp_replace(regexp_extract(p, '^(.*)/[^/]*$', 1), '/+', '/', 'g') folder, '/data/b/x' absolute from x"""


def split_join(spark, d):
    parts = strings.split(c("p_name"), " ")
    return load(spark, d, "part").select("p_partkey", F.size(parts).cast("bigint").alias("n"), lists.join(parts, "-").alias("joined"), lists.join(strings.split(c("p_brand")), ".").alias("spelled"))


SPLIT_JOIN = "select p_partkey, len(string_split(p_name, ' '))::bigint n, array_to_string(string_split(p_name, ' '), '-') joined, array_to_string(string_split(p_brand, ''), '.') spelled from part"


def regex_sub(spark, d):
    return load(spark, d, "part").select("p_partkey", strings.sub(c("p_brand"), r"Brand#(\d+)", "B-$1").alias("brand"), strings.sub(c("p_name"), r"([aeiou])", "<${1}>").alias("vowels"), strings.sub(c("p_brand"), r"(\d)", "$1x").alias("named"))


REGEX_SUB = r"select p_partkey, regexp_replace(p_brand, 'Brand#(\d+)', 'B-\1', 'g') brand, regexp_replace(p_name, '([aeiou])', '<\1>', 'g') vowels, regexp_replace(p_brand, '(\d)', '', 'g') named from part"


def contains_str(spark, d):
    return load(spark, d, "documents").where(strings.contains(c("text"), "tion") & strings.contains(c("text"), "")).select("doc_id", strings.elide(c("source"), 4).alias("short"), strings.html_escape(F.concat(F.lit("<"), c("lang"), F.lit("&>"))).alias("html"), strings.safe_name(F.concat(c("source"), F.lit("/ x"))).alias("safe"))


CONTAINS_STR = "select doc_id, case when length(source) > 4 then left(source, 3) || '…' else source end short, '&lt;' || lang || '&amp;&gt;' html, source || '__x' safe from documents where contains(text, 'tion')"


def cartesian_template(spark, d):
    seg = load(spark, d, "customer").select(c("c_mktsegment").alias("seg")).distinct()
    rows = sheet.products(load(spark, d, "region").select("r_name"), seg)
    inner = lists.join(strings.product(F.array(c("r_name"), F.lit("all")), F.array(F.lit("-")), F.array(c("seg"), F.lit("any"))), " ")
    return rows.select("r_name", "seg", strings.template("out/", c("r_name"), "_", c("seg"), ".txt").alias("name"), inner.alias("combinations"))


CARTESIAN_TEMPLATE = """select r_name, seg, 'out/' || r_name || '_' || seg || '.txt' "name", r_name || '-' || seg || ' ' || r_name || '-any all-' || seg || ' all-any' combinations
from region, (select distinct c_mktsegment seg from customer)"""


def placeholders(spark, d):
    path = F.concat(F.lit("data/set"), c("p_size"), F.lit("/"), F.replace(c("p_name"), F.lit(" "), F.lit("_")), F.lit(".fq.gz"))
    own = load(spark, d, "part").select("p_partkey", path.alias("path"))
    return own.select("p_partkey", strings.placeholders("in={} base={@} stem={@.fq.gz} no={^.bam} n={#} lit={{}} odd={x}", c("path"), c("p_partkey")).alias("line"))


PLACEHOLDERS = """with x as (select p_partkey, 'data/set' || p_size || '/' || replace(p_name, ' ', '_') p, replace(p_name, ' ', '_') b from part)
select p_partkey, 'in=' || p || '.fq.gz base=' || b || '.fq.gz stem=' || b || ' no=' || p || '.fq.gz n=' || p_partkey || ' lit={} odd={x}' line from x"""


def mem_units(spark, d):
    unit = F.when(c("p_size") % 4 == 0, "G").when(c("p_size") % 4 == 1, "M").when(c("p_size") % 4 == 2, "gb").otherwise("")
    amount = F.concat(c("p_size").cast("string"), unit)
    return load(spark, d, "part").select("p_partkey", amount.alias("amount"), strings.memory(amount).alias("megabytes"), strings.memory(amount, "suffix").alias("suffixed"))


MEM_UNITS = """with x as (select p_partkey, p_size, p_size::varchar || case p_size % 4 when 0 then 'G' when 1 then 'M' when 2 then 'gb' else '' end amount from part)
select p_partkey, amount, (case when p_size % 4 in (0, 2) then p_size * 1000 else p_size end)::varchar megabytes, lower(amount) || 'b' suffixed from x"""


def _order_lines(spark, d):
    return sheet.group_gather(load(spark, d, "lineitem").select("l_orderkey", c("l_partkey").cast("string").alias("p"), c("l_linenumber").alias("n"), c("l_suppkey").alias("s"), c("l_quantity").alias("q")), "l_orderkey", "p", ["n", "p", "s", "q"])


def list_slice(spark, d):
    x = _order_lines(spark, d)
    return x.select("l_orderkey", *(lists.join(lists.cut(c("items"), a, b), ",").alias(n) for n, a, b in (("head", None, 2), ("tail", -2, None), ("middle", 1, -1), ("empty", 3, 1))), lists.item(c("items"), 0).alias("first_item"), lists.item(c("items"), -1).alias("last_item"))


_LINES = "with x as (select l_orderkey, list(l_partkey::varchar order by l_linenumber, l_partkey::varchar, l_suppkey, l_quantity) i from lineitem group by 1) "
LIST_SLICE = _LINES + """select l_orderkey, array_to_string(i[1:2], ',') head, array_to_string(i[greatest(len(i) - 1, 1):len(i)], ',') tail, coalesce(array_to_string(case when len(i) > 2 then i[2:len(i) - 1] else [] end, ','), '') middle, '' empty, i[1] first_item, i[len(i)] last_item from x"""


def list_ops(spark, d):
    x = _order_lines(spark, d)
    i = c("items")
    return x.select("l_orderkey", F.size(i).cast("bigint").alias("n"), lists.has(i, F.lit(7), "string", "int").alias("has_7"), F.size(F.concat(i, i)).cast("bigint").alias("doubled"), F.size(lists.repeat(i, F.lit(-1))).cast("bigint").alias("none"), lists.join(lists.unique(i), " ").alias("uniq"), lists.same_set(i, F.reverse(F.concat(i, i))).alias("same"), lists.any_contains(i, "99").alias("some_99"), lists.join(lists.append(i, F.lit("end")), " ").alias("appended"))


LIST_OPS = _LINES + """, u as (select l_orderkey, string_agg(v, ' ' order by k) uniq from (select l_orderkey, v, min(k) k from (select l_orderkey, unnest(i) v, generate_subscripts(i, 1) k from x) group by 1, 2) group by 1)
select l_orderkey, len(i)::bigint n, list_contains(i, '7') has_7, (2 * len(i))::bigint doubled, 0::bigint "none", uniq, true same, contains(array_to_string(i, ' '), '99') some_99, array_to_string(i, ' ') || ' end' appended from x join u using (l_orderkey)"""


def range_ops(spark, d):
    lo, hi = c("p_size").cast("bigint"), F.lit(20).cast("bigint")
    return load(spark, d, "part").select("p_partkey", lists.range_length(lo, hi).alias("n"), lists.range_has(lo, hi, F.lit(18)).alias("has_18"), F.coalesce(lists.range_item(lo, hi, 1), F.lit(-1)).alias("second"), lists.range_item(lo, hi, -1).alias("final"), lists.join(lists.range_list(lo, hi), ",", "bigint").alias("listed"))


RANGE_OPS = """select p_partkey, (abs(20 - p_size) + 1)::bigint n, 18 between least(p_size, 20) and greatest(p_size, 20) has_18,
case when p_size = 20 then -1 when p_size < 20 then p_size + 1 else p_size - 1 end::bigint "second", 20::bigint "final",
array_to_string(case when p_size <= 20 then range(p_size, 21) else range(p_size, 19, -1) end, ',') listed from part"""


def map_ops(spark, d):
    m = F.create_map(F.lit("name"), c("n_name"), F.lit("region"), c("n_regionkey").cast("string"), F.lit("none"), F.lit(None).cast("string"))
    own = load(spark, d, "nation").select("n_nationkey", "n_name", m.alias("m"))
    put = lists.map_put(c("m"), F.lit("name"), F.lit("x"))
    return own.select(
        "n_nationkey", lists.map_get(c("m"), "name").alias("got"), lists.map_get(c("m"), "zip", F.lit("?")).alias("missing"), lists.map_get(c("m"), "none", F.lit("?")).isNull().alias("present_null"), F.map_contains_key("m", "region").alias("has_region"),
        lists.join(F.map_keys("m"), ",").alias("keys"), F.size("m").cast("bigint").alias("n"), lists.map_item(c("m"), 1).alias("by_place"), values.text(put, "map<string,string>").alias("upserted"), F.size(lists.map_put_missing(c("m"), F.lit("k"), F.lit("v"))).cast("bigint").alias("grown"))


MAP_OPS = """select n_nationkey, n_name got, '?' missing, true present_null, true has_region, 'name,region,none' keys, 3::bigint n, n_regionkey::varchar by_place, 'region=' || n_regionkey || ' none= name=x' upserted, 4::bigint grown from nation"""


def settings_sig(spark, d):
    m = F.create_map(F.lit("job.mem"), F.concat(c("p_size").cast("string"), F.lit("G")), F.lit("job.name"), c("p_name"), F.lit("job.array"), c("p_partkey").cast("string"), F.lit("other"), F.lit("x"), F.lit("job.brand"), c("p_brand"))
    own = load(spark, d, "part").select("p_type", lists.signature(m).alias("sig"), lists.join(F.map_keys(lists.settings(m)), ",").alias("kept"))
    return own.groupBy("p_type").agg(F.countDistinct("sig").alias("signatures"), F.min("sig").alias("first_sig"), F.max("kept").alias("kept"))


SETTINGS_SIG = "select p_type, count(distinct s)::bigint signatures, min(s) first_sig, 'mem,brand' kept from (select p_type, 'job.brand=' || p_brand || ';job.mem=' || p_size || 'G;job.name=' || p_name || ';' s from part) group by 1"


def cell_typing(spark, d):
    cell = F.get_json_object("props", "$.k")
    odd = F.when(c("event_id") % 5 == 0, F.concat(cell, F.lit(".5"))).when(c("event_id") % 5 == 1, "true").when(c("event_id") % 5 == 2, F.concat(cell, F.lit("x"))).when(c("event_id") % 5 == 3, F.concat(F.lit("1e"), F.lit("5"))).otherwise(cell)
    return load(spark, d, "events").select("event_id", odd.alias("cell"), values.kind(odd).alias("kind"))


CELL_TYPING = """with x as (select event_id, props::json->>'$.k' k from events)
select event_id, case event_id % 5 when 0 then k || '.5' when 1 then 'true' when 2 then k || 'x' when 3 then '1e5' else k end "cell", case event_id % 5 when 0 then 'float' when 1 then 'bool' when 2 then 'string' when 3 then 'float' else 'int' end kind from x"""


def tsv_roundtrip(spark, d):
    path = scratch(spark, "tsv")
    sheets.write_delimited(load(spark, d, "customer").repartition(5), path)
    out = sheets.read_tsv(spark, path)
    return out.select(c("c_custkey").cast("bigint"), "c_name", c("c_nationkey").cast("bigint"), "c_acctbal", "c_mktsegment")


def csv_roundtrip(spark, d):
    """Cells with separators, quotes and line feeds, over several part files."""
    path = scratch(spark, "csv")
    own = load(spark, d, "supplier").select("s_suppkey", F.concat(c("s_name"), F.lit(', "x"'), F.when(c("s_suppkey") % 3 == 0, "\nmore").otherwise("")).alias("s_name"), c("s_nationkey").cast("bigint").alias("s_nationkey"))
    sheets.write_delimited(own.repartition(3), path, ",")
    return sheets.read_csv(spark, path)


def tsv_skip(spark, d):
    """Sheets with comments, blank lines and a line before the header, which is wider than that line and than some records."""
    path = scratch(spark, "skip")
    own = load(spark, d, "part").select(F.lit(1).alias("o"), c("p_partkey").alias("k"), F.concat_ws("\t", c("p_partkey").cast("string"), "p_name", F.when(c("p_size") % 2 == 0, c("p_size").cast("string"))).alias("value"))
    head = spark.range(1).select(F.explode(F.array(F.lit("# list of parts"), F.lit("made today"), F.lit(""), F.lit("key\tname\tsize"))).alias("value")).select(F.lit(0).alias("o"), F.monotonically_increasing_id().alias("k"), "value")
    head.union(own).orderBy("o", "k").coalesce(1).select("value").write.text(path)
    return sheets.read_tsv(spark, path, skip=1, raw=True)


def lines_skip(spark, d):
    """The first two lines dropped, blank ones kept."""
    path = scratch(spark, "lines")
    load(spark, d, "nation").orderBy("n_nationkey").select(F.when(c("n_nationkey") % 4 == 3, "").otherwise(c("n_name")).alias("v")).coalesce(1).write.text(path)
    return sheets.read_lines(spark, path, skip=2)


def text_whole(spark, d):
    """A file as one text, and a list of paths: trimmed, without blank lines."""
    path = scratch(spark, "whole")
    load(spark, d, "region").orderBy("r_regionkey").coalesce(1).select(F.concat(F.lit("  "), c("r_name"), F.when(c("r_regionkey") == 2, "\n").otherwise(" ")).alias("value")).write.text(path)
    whole = sheets.read_text(spark, path).select(F.lit("whole").alias("how"), F.sha2(c("value"), 256).alias("value"))
    return whole.union(sheets.read_paths(spark, path).select(F.lit("path").alias("how"), c("path").alias("value")))


def files_there(spark, d):
    """Which of some paths are files, folders, or absent, by one listing."""
    path = scratch(spark, "files").removeprefix("file:")
    load(spark, d, "nation").select((c("n_nationkey") % 3).alias("g"), "n_name").write.partitionBy("g").text(path)
    found = sheets.read_files(spark, path)
    plain = F.regexp_replace("path", "^file:/+", "/")
    asked = found.select(plain.alias("path")).union(spark.createDataFrame([(path,), (f"{path}/g=1",), (f"{path}/g=7",)], "path string"))
    kinds = sheets.file_kinds(asked, found)
    return kinds.groupBy(F.regexp_extract("path", "(g=.)?[^/]*$", 1).alias("part"), F.when(c("path").contains("part-"), "file").otherwise("other").alias("asked")).agg(F.bool_or("exists").alias("there"), F.bool_and("isfile").alias("files"), F.bool_and("isdir").alias("folders"))


def type_words(spark, d):
    own = load(spark, d, "part").select("p_partkey", *(values.type_word(x).alias(n) for n, x in (("a", c("p_partkey")), ("b", c("p_retailprice")), ("c", c("p_name")), ("d", F.array("p_name")), ("e", F.create_map(c("p_name"), c("p_size"))), ("f", c("p_size") > 1), ("g", c("p_size")))))
    return own


def names_elided(spark, d):
    """Bytes, not characters, are counted; each kind of name has its own rule."""
    name = F.concat(c("n_name"), F.lit("/x-y z"))
    return load(spark, d, "nation").select("n_nationkey", strings.elide(c("n_name"), 7).alias("short"), F.octet_length(strings.elide(F.concat(F.lit("é"), c("n_name")), 8)).cast("bigint").alias("wide"), strings.safe_name(name).alias("host"), strings.option_name(name).alias("option_"), strings.job_name(name).alias("job"))


def maps_listed(spark, d):
    """A map's pairs and keys as rows in order; a value, a list and nothing as lists; powers with negative and broken exponents."""
    m = F.create_map(F.lit("name"), c("n_name"), F.lit("region"), c("n_regionkey").cast("string"))
    pairs = load(spark, d, "nation").select("n_nationkey", F.posexplode(F.map_entries(m)).alias("k", "e"))
    listed = lists.listed(F.when(c("n_nationkey") % 2 == 0, c("e.value")))
    size = c("n_nationkey").cast("bigint")
    return pairs.select("n_nationkey", c("k").cast("bigint").alias("k"), c("e.key").alias("key_"), c("e.value").alias("value_"), lists.join(listed, ",").alias("listed"), F.round(F.pow(size + 1, F.lit(-2)), 9).alias("negative"), F.round(F.pow(size, F.lit(0.5)), 9).alias("root"))


def json_roundtrip(spark, d):
    path = scratch(spark, "json")
    sheets.json_array(load(spark, d, "region")).write.text(path)
    return sheets.read_json(spark, path)


def lines_read(spark, d):
    path = scratch(spark, "lines")
    sheets.write_lines(load(spark, d, "nation").select(F.concat(F.when(c("n_regionkey") == 0, "# ").otherwise(""), c("n_name"), F.lit("\r")).alias("v")), path)
    return sheets.read_lines(spark, path, comment="#", blank=False)


QUERIES = {f.__name__: f for f in (
    int_math, float_mod, float_text, truthiness, coerced_eq, default_value, numeric_filter, string_case_len, path_parts, split_join, regex_sub, contains_str, cartesian_template, placeholders,
    mem_units, list_slice, list_ops, range_ops, map_ops, settings_sig, cell_typing, tsv_roundtrip, csv_roundtrip, tsv_skip, lines_skip, text_whole, files_there, type_words, names_elided, maps_listed, json_roundtrip, lines_read)}
SQL = {
    "int_math": INT_MATH, "float_mod": FLOAT_MOD, "float_text": FLOAT_TEXT, "truthiness": TRUTHINESS, "coerced_eq": COERCED_EQ, "default_value": DEFAULT_VALUE, "numeric_filter": NUMERIC_FILTER, "string_case_len": STRING_CASE_LEN,
    "path_parts": PATH_PARTS, "split_join": SPLIT_JOIN, "regex_sub": REGEX_SUB, "contains_str": CONTAINS_STR, "cartesian_template": CARTESIAN_TEMPLATE, "placeholders": PLACEHOLDERS, "mem_units": MEM_UNITS, "list_slice": LIST_SLICE,
    "list_ops": LIST_OPS, "range_ops": RANGE_OPS, "map_ops": MAP_OPS, "settings_sig": SETTINGS_SIG, "cell_typing": CELL_TYPING,
    "tsv_roundtrip": "select c_custkey::bigint c_custkey, c_name, c_nationkey::bigint c_nationkey, c_acctbal, c_mktsegment from customer",
    "csv_roundtrip": "select s_suppkey, s_name || ', \"x\"' || case when s_suppkey % 3 = 0 then chr(10) || 'more' else '' end s_name, s_nationkey::bigint s_nationkey from supplier",
    "tsv_skip": "select p_partkey::varchar \"key\", p_name \"name\", case when p_size % 2 = 0 then p_size::varchar else '' end size from part",
    "lines_skip": "select case when n_nationkey % 4 = 3 then '' else n_name end \"value\" from nation where n_nationkey >= 2",
    "text_whole": "select 'whole' how, sha256(string_agg('  ' || r_name || case when r_regionkey = 2 then chr(10) else ' ' end || chr(10), '' order by r_regionkey)) \"value\" from region union all select 'path', r_name from region",
    "files_there": "select * from (values ('', 'other', true, false, true), ('g=1', 'other', true, false, true), ('g=7', 'other', false, false, false), ('', 'file', true, true, false)) t(part, asked, there, files, folders)",
    "type_words": "select p_partkey, 'int' a, 'float' b, 'string' c, 'list' d, 'map' e, 'bool' f, 'int' g from part",
    "names_elided": "select n_nationkey, case when length(n_name) > 7 then n_name[1:6] || '…' else n_name end short, case when length(n_name) + 2 > 8 then 10 else length(n_name) + 2 end::bigint wide, n_name || '_x-y_z' host, n_name || '/x_y z' option_, n_name || '_x-y z' job from nation",
    "maps_listed": "select n_nationkey, k::bigint k, key_, value_, case when n_nationkey % 2 = 0 then value_ else '' end listed, round(power(n_nationkey + 1, -2.0), 9) negative, round(power(n_nationkey, 0.5), 9) root from (select n_nationkey, 0 k, 'name' key_, n_name value_ from nation union all select n_nationkey, 1, 'region', n_regionkey::varchar from nation)",
    "json_roundtrip": "select r_name, r_regionkey::bigint r_regionkey from region",
    "lines_read": "select n_name \"value\" from nation where n_regionkey <> 0",
}
