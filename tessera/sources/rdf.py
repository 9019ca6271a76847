"""Graphs in Turtle and N-Triples files.

Turtle: prefixes, base, ``a``, ``;`` and ``,`` lists, nested blank nodes, collections aside, literals with
language or datatype, numbers and booleans, comments. A file is parsed as a whole by one task (a statement may
span lines); files are read in parallel. Blank nodes get names from the file and their order, so reading twice
gives the same. A file that can't be parsed raises, unless bad files are to be skipped.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.arrow import record
from ..functions.text import unfenced

TRIPLE = "s s_kind p o o_kind o_datatype o_lang".split()
TRIPLES = "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string"
_SCHEMA = pa.schema([(c, pa.string()) for c in "s s_kind p o o_kind o_datatype o_lang".split()])

_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\")|(?P<text>"(?:[^"\\\n]|\\.)*")
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<blank>_:[\w.-]*\w)|(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)(?![\w:])
    |(?P<name>(?:[^\W\d][\w.-]*)?:(?:[\w:%‰°²³/-](?:[\w.:%‰°²³/-]*[\w:%‰°²³/-])?)?)|(?P<word>[A-Za-z]+)|(?P<sign>[.;,\[\]])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), text)


class TurtleError(ValueError):
    pass


class _Reader:
    """A recursive descent over the tokens of one text."""

    def __init__(self, text: str, base: str, scope: str):
        self.tokens, self.at, self.base, self.scope, self.made = [], 0, base, scope, 0
        self.prefixes = {"": base, "rdf": v.RDF, "rdfs": v.RDFS, "owl": v.OWL, "xsd": v.XSD}
        self.triples: list[tuple] = []
        place = 0
        while place < len(text):
            m = _TOKEN.match(text, place)
            if not m:
                raise TurtleError(f"at character {place}: {text[place : place + 30]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m.group()))
            place = m.end()

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self, want: str | None = None):
        kind, text = self.peek()
        if want is not None and text != want:
            raise TurtleError(f"expected {want!r}, found {text!r}")
        self.at += 1
        return kind, text

    def fresh(self):
        self.made += 1
        return f"_:{self.scope}b{self.made}", "bnode"

    def document(self):
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if text.lower() in ("@prefix", "@base", "prefix", "base"):
                self.next()
                name = self.next()[1][:-1] if "prefix" in text.lower() else None
                iri = self.resolve(self.next()[1])
                if name is None:
                    self.base = iri
                else:
                    self.prefixes[name] = iri
                if self.peek()[1] == ".":
                    self.next()
                continue
            if text == "[":
                subject = self.nested()
                if self.peek()[1] != ".":
                    self.predicates(subject)
            else:
                subject = self.node()[:2]
                self.predicates(subject)
            self.next(".")
        return self.triples

    def resolve(self, iri: str) -> str:
        iri = _unescaped(iri[1:-1])
        return iri if re.match(r"[A-Za-z][\w+.-]*:", iri) else self.base + iri

    def predicates(self, subject):
        while True:
            kind, text = self.peek()
            if text in (".", "]"):
                return
            if kind == "word" and text == "a":
                self.next()
                predicate = v.TYPE
            else:
                predicate = self.node()[0]
            while True:
                self.triples.append((*subject, predicate, *self.object()))
                if self.peek()[1] != ",":
                    break
                self.next()
            while self.peek()[1] == ";":
                self.next()

    def nested(self):
        self.next("[")
        node = self.fresh()
        self.predicates(node)
        self.next("]")
        return node

    def node(self):
        kind, text = self.next()
        if kind == "iri":
            return self.resolve(text), "uri"
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + local, "uri"
        if kind == "blank":
            return f"_:{self.scope}{text[2:]}", "bnode"
        raise TurtleError(f"no node: {text!r}")

    def object(self):
        kind, text = self.peek()
        if text == "[":
            return (*self.nested(), None, None)
        if kind in ("text", "long"):
            self.next()
            value = _unescaped(text[3:-3] if kind == "long" else text[1:-1])
            kind, text = self.peek()
            if kind == "lang":
                self.next()
                return value, "literal", None, text[1:]
            if kind == "type":
                self.next()
                return value, "literal", self.node()[0], None
            return value, "literal", None, None
        if kind == "number":
            self.next()
            name = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return text, "literal", v.XSD + name, None
        if kind == "word" and text in ("true", "false"):
            self.next()
            return text, "literal", v.XSD + "boolean", None
        return (*self.node(), None, None)


def parse_turtle(text: str, base: str = v.NS, scope: str = "") -> list[tuple]:
    """Rows (s, s_kind, p, o, o_kind, o_datatype, o_lang) of a Turtle text."""
    return _Reader(text, base, scope).document()


def read_turtle(spark: SparkSession, path: str, base: str = v.NS, skip_bad: bool = False, scoped: bool = True) -> DataFrame:
    """The triples of all Turtle files at ``path``, as a set. scoped: a blank node's name is its file's own,
    as usual; files that ``write_turtle`` made are one graph and are read without."""

    def run(batches):
        for b in batches:
            rows = []
            for text, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += parse_turtle(text or "", base, name if scoped else "")
                except TurtleError:
                    if not skip_bad:
                        raise
            yield record(_SCHEMA, *(map(list, zip(*rows)) if rows else [[] for _ in _SCHEMA]))

    files = spark.read.text(path, wholetext=True).select("value", F.concat(F.lit("f"), F.hex(F.xxhash64("_metadata.file_path"))).alias("scope"))
    return files.mapInArrow(run, TRIPLES).distinct()


def parsed_replies(replies: DataFrame, base: str = v.NS) -> DataFrame:
    """(id, triple columns) of model replies (id, text) in Turtle, also between fences or with prefixes
    undeclared; replies that can't be read give none (``reply_errors`` names them)."""
    return _parsed(replies, base).filter("s IS NOT NULL").drop("error")


def reply_errors(replies: DataFrame, base: str = v.NS) -> DataFrame:
    """(id, error) of the replies that can't be read."""
    return _parsed(replies, base).filter("error IS NOT NULL").select("id", "error")


#: Prefixes that replies use without declaring them. Fixed values.
_USUAL = {"skos": "http://www.w3.org/2004/02/skos/core#", "foaf": "http://xmlns.com/foaf/0.1/", "geo": "http://www.w3.org/2003/01/geo/wgs84_pos#", "dc": "http://purl.org/dc/elements/1.1/", "dcterms": "http://purl.org/dc/terms/", "schema": "http://schema.org/"}
_UNKNOWN = re.compile(r"unknown prefix '([^']*)'")


def repaired(text: str, base: str = v.NS, scope: str = "") -> list[tuple]:
    """The triples of a reply: as it is, then with each unknown prefix declared (one that isn't a usual one as
    the base), and without an unfinished last statement. Raises if that doesn't help."""
    declared: set[str] = set()
    while True:
        try:
            return parse_turtle(text, base, scope)
        except TurtleError as e:
            m = _UNKNOWN.search(str(e))
            if m and m[1] not in declared:
                declared.add(m[1])
                text = f"@prefix {m[1]}: <{_USUAL.get(m[1], base)}> .\n{text}"
                continue
            whole = text.rstrip()
            at = max(whole.rfind(".\n"), whole.rfind(". "))
            if at > 0 and not whole.endswith(".") and "cut" not in declared:
                declared.add("cut")
                text = whole[: at + 1]
                continue
            raise


def _parsed(replies: DataFrame, base: str) -> DataFrame:
    schema = pa.schema([("id", pa.string()), *[(f.name, f.type) for f in _SCHEMA], ("error", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(i, *t, None) for t in repaired(text or "", base, f"{i}-")]
                except TurtleError as e:
                    rows.append((i, *[None] * len(_SCHEMA), str(e)[:500]))
            yield record(schema, *(map(list, zip(*rows)) if rows else [[] for _ in schema]))

    return replies.select(F.col("id").cast("string"), unfenced(F.col("text")).alias("text")).mapInArrow(run, "id string, " + TRIPLES + ", error string")


def classified(new: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, node): the classes, properties and instances that new triples define and the graph doesn't."""
    kinds = F.when(F.col("o") == v.OWL + "Class", "class").when(F.col("o").isin([v.OWL + "ObjectProperty", v.OWL + "DatatypeProperty"]), "property").otherwise("instance")
    typed = lambda t: t.filter((F.col("p") == v.TYPE) & (F.col("s_kind") == "uri") & (F.col("o_kind") == "uri")).select(kinds.alias("kind"), F.col("s").alias("node")).distinct()
    return typed(new).join(typed(known), ["kind", "node"], "left_anti")


def merged_replies(replies: DataFrame, known: DataFrame, base: str = v.NS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replies joined to a graph: (the graph as a set, (kind, added) of what is new with the triples added,
    (id, error) of replies that can't be read)."""
    columns = TRIPLE
    old, new = known.select(*columns).distinct(), parsed_replies(replies, base).select(*columns).distinct()
    added = new.join(old.withColumn("_old", F.lit(1)), [old[c].eqNullSafe(new[c]) for c in columns], "left_anti")
    counts = classified(new, old).groupBy("kind").agg(F.count("*").alias("added")).unionByName(added.agg(F.count("*").alias("added")).select(F.lit("triple").alias("kind"), "added"))
    return old.unionByName(added), counts, reply_errors(replies, base)


def _escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """(value): a line for each triple."""
    node = lambda c, kind: F.when(kind == "bnode", c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    literal = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise(""))
    o = F.when(F.col("o_kind") == "literal", literal).otherwise(node(F.col("o"), F.col("o_kind")))
    return triples.select(F.concat(node(F.col("s"), F.col("s_kind")), F.lit(" <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    """To a folder that doesn't exist yet: an older version is never overwritten."""
    ntriples_lines(triples).write.mode("error").text(path)


_LOCAL = re.compile(r"[^\W\d_][\w-]*").fullmatch


def _turtle_blocks(batches):
    """Lines of Turtle of sorted triples: prefixes, then one statement for each run of a subject."""
    prefixes = {v.NS: "", v.RDF: "rdf", v.RDFS: "rdfs", v.OWL: "owl", v.XSD: "xsd"}
    out, last = [f"@prefix {p}: <{ns}> ." for ns, p in prefixes.items()], None

    def node(x, kind):
        if kind == "bnode":
            return x
        ns, _, local = x.rpartition("#")
        return f"{prefixes[ns + '#']}:{local}" if ns + "#" in prefixes and _LOCAL(local) else f"<{x}>"

    def literal(o, datatype, lang):
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            o = o.replace(a, b)
        return f'"{o}"' + (f"@{lang}" if lang else f"^^{node(datatype, 'uri')}" if datatype else "")

    lines = pa.schema([("value", pa.string())])
    for b in batches:
        for s, s_kind, p, o, o_kind, datatype, lang in zip(*(c.to_pylist() for c in b.columns)):
            told = f"{'a' if p == v.TYPE else node(p, 'uri')} {literal(o, datatype, lang) if o_kind == 'literal' else node(o, o_kind)}"
            if s == last:
                out[-1] += " ;"
                out.append(f"  {told}")
            else:
                if last is not None:
                    out[-1] += " ."
                out.append(f"{node(s, s_kind)} {told}")
                last = s
        if len(out) > 1:  # the last line may go on in the next batch
            yield pa.RecordBatch.from_pydict({"value": out[:-1]}, lines)
            out = out[-1:]
    if last is not None:
        out[-1] += " ."
    yield pa.RecordBatch.from_pydict({"value": out}, lines)


def write_turtle(triples: DataFrame, path: str, backup: bool = True, dry_run: bool = False) -> dict:
    """Triples as Turtle files in the folder ``path``: {"triples", "written", "backup"}. What stands there is
    renamed to ``path.bak-N`` first, or without ``backup`` kept and an error raised; a dry run only counts.

    Subjects are in order over all files; one with very many triples goes on in the next file."""
    spark, t = triples.sparkSession, triples.select(*TRIPLE).distinct()
    if dry_run:
        return {"triples": t.count(), "written": False, "backup": None}
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, moved = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), None
    if fs.exists(at):
        if not backup:
            raise FileExistsError(path)
        n = 1
        while fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.bak-{n}")):
            n += 1
        moved = f"{path}.bak-{n}"
    new = f"{path}.new"
    t.repartitionByRange("s", "p", "o").sortWithinPartitions("s", "p", "o").mapInArrow(_turtle_blocks, "value string").write.mode("overwrite").text(new)
    if moved:  # only once the new one is whole
        fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(moved))
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(new), at)
    return {"triples": read_turtle(spark, f"{path}/*.txt", scoped=False).count(), "written": True, "backup": moved}


def parsed_bindings(replies: DataFrame) -> DataFrame:
    """(id, n, name, value, kind, datatype, lang) of SPARQL results in JSON (id, text): the n-th row's bindings.
    Texts that are none give no rows."""
    cell = "struct<type: string, value: string, datatype: string, `xml:lang`: string>"
    rows = replies.select(F.col("id").cast("string"), F.from_json("text", f"results struct<bindings: array<map<string, {cell}>>>").alias("r"))
    one = rows.select("id", F.posexplode("r.results.bindings").alias("n", "row")).select("id", "n", F.explode("row").alias("name", "x"))
    return one.select("id", "n", "name", F.col("x.value").alias("value"), F.col("x.type").alias("kind"), F.col("x.datatype").alias("datatype"), F.col("x")["xml:lang"].alias("lang"))


def endpoint_triples(queries: DataFrame, fetch, names: tuple[str, str, str] = ("s", "p", "o")) -> DataFrame:
    """(id, TRIPLES) that an endpoint gives for queries (id, query). fetch: function from a query's text to the
    endpoint's JSON, called in the workers; what fails there is an empty result."""

    def run(batches):
        for b in batches:
            texts = []
            for q in b.column(1).to_pylist():
                try:
                    texts.append(fetch(q))
                except Exception:  # noqa: BLE001
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], schema=pa.schema([("id", pa.string()), ("text", pa.string())]))

    cells = parsed_bindings(queries.select(F.col("id").cast("string"), "query").mapInArrow(run, "id string, text string"))
    pick = lambda name: F.max(F.when(F.col("name") == name, F.struct("value", "kind", "datatype", "lang"))).alias(name)
    rows = cells.groupBy("id", "n").agg(*[pick(x) for x in names]).filter(" AND ".join(f"{x} IS NOT NULL" for x in names))
    s, p, o = names
    name = lambda c: F.when(F.col(f"{c}.kind") == "bnode", F.concat(F.lit("_:"), F.regexp_replace(f"{c}.value", "^_:", ""))).otherwise(F.col(f"{c}.value"))
    kind = lambda c: F.when(F.col(f"{c}.kind") == "typed-literal", "literal").otherwise(F.col(f"{c}.kind"))
    return rows.select("id", name(s).alias("s"), kind(s).alias("s_kind"), F.col(f"{p}.value").alias("p"), name(o).alias("o"), kind(o).alias("o_kind"), F.col(f"{o}.datatype").alias("o_datatype"), F.col(f"{o}.lang").alias("o_lang"))


_LINE = r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([\w-]+)|\^\^<([^>]*)>)?)\s*\.\s*$'


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """The triples of N-Triples files, as a set; lines that are none are left out."""
    part = lambda i: F.nullif(F.regexp_extract("value", _LINE, i), F.lit(""))
    text = F.regexp_extract("value", _LINE, 6)
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    lines = spark.read.text(path).filter(F.col("value").rlike(_LINE))
    return lines.select(
        F.coalesce(part(1), part(2)).alias("s"), F.when(part(1).isNotNull(), "uri").otherwise("bnode").alias("s_kind"), part(3).alias("p"),
        F.coalesce(part(4), part(5), text).alias("o"), F.when(part(4).isNotNull(), "uri").when(part(5).isNotNull(), "bnode").otherwise("literal").alias("o_kind"),
        part(8).alias("o_datatype"), part(7).alias("o_lang"),
    ).distinct()


def instance_names(spark: SparkSession, path: str) -> DataFrame:
    """(name): the names that begin statements of Turtle files with a type, sorted."""
    found = F.regexp_extract_all("value", F.lit(r"(?m)^\s*:([^\s;,.\[\]]+)\s+(?:a|rdf:type)\s"), F.lit(1))
    return spark.read.text(path, wholetext=True).select(F.explode(found).alias("name")).distinct().orderBy("name")
