"""The change pipeline: batches of file versions to entities, operations and a new graph.

State lives in Parquet tables, one folder for each batch and a pointer to the last complete one, so
that a batch that runs again writes the same rows to the same place.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import extract_entities, extract_nodes
from ..functions import vocab
from ..functions.names import node_id
from ..operators import delta, lookup, resolve
from ..operators.mutate import Graph
from ..session import shared_table

ENTITY = "file_path string, seq bigint, name string, type string, sig string, struct string, line_start int, line_end int, ord bigint, calls array<string>, inherits array<string>, imports array<struct<module:string,name:string>>, type_refs array<string>, decorators array<string>, uses array<string>"
NODES = "id string, type string, name string, file_path string, line_start bigint, ord bigint, calls array<string>, inherits array<string>, imports array<struct<module:string,name:string>>, type_refs array<string>, decorators array<string>, uses array<string>"
EDGES = "source_id string, target_id string, edge_type string, confidence string"
OPS = "file_path string, seq bigint, name string, kind string, old_name string, op_type string, place int, batch bigint"


def entities_of(versions: DataFrame) -> DataFrame:
    """Entities of file versions (file_path, seq, content)."""
    keyed = versions.withColumn("key", F.concat_ws("\u0001", F.col("seq").cast("string"), "file_path"))
    e = extract_entities(keyed.select(F.col("key").alias("file_path"), "content"))
    path, seq = F.substring_index("file_path", "\u0001", -1), F.substring_index("file_path", "\u0001", 1).cast("bigint")
    return e.select(path.alias("file_path"), seq.alias("seq"), "name", F.col("entity_type").alias("type"), F.col("signature_hash").alias("sig"), F.col("structure_hash").alias("struct"), "line_start", "line_end", "ord", "calls", "inherits", "imports", "type_refs", "decorators", "uses")


def nodes_of(entities: DataFrame) -> DataFrame:
    """A node for each entity name and type of a file, the last by place."""
    e = entities.withColumn("id", node_id(F.col("file_path"), F.col("type"), F.col("name")))
    last = e.groupBy("id").agg(F.max_by(F.struct("type", "name", "file_path", F.col("line_start").cast("bigint").alias("line_start"), "ord", "calls", "inherits", "imports", "type_refs", "decorators", "uses"), "ord").alias("n"))
    return last.select("id", "n.*")


def project_nodes(files: DataFrame) -> DataFrame:
    """The nodes of a project (file_path, content), a row a file.

    As ``nodes_of`` its entities, but a file's are told apart by the task that parses it: nothing is shuffled.
    """
    e = extract_nodes(files).withColumnRenamed("entity_type", "type").withColumn("line_start", F.col("line_start").cast("bigint"))
    return e.select(node_id(F.col("file_path"), F.col("type"), F.col("name")).alias("id"), "type", "name", "file_path", "line_start", "ord", "calls", "inherits", "imports", "type_refs", "decorators", "uses")


_SOURCE, _TARGET = ("source_id", "source", "file_path"), ("target_id", "target", "target_file")


def import_links(nodes: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What import nodes lead to, and what each says, written once with its direct targets.

    A name of a module goes to its definition there, or along the imports by which that module has it
    (five at most): high. ``*`` goes to all that the module exports: medium. A name whose module is
    unknown goes to the first definition of the name in another file: medium. Links have source, place
    in its file, target, its ord and confidence.
    """
    place, at = F.col("ord").alias("place"), F.posexplode("imports").alias("pos", "i")
    source = nodes.where("type = 'import'").select(F.col("id").alias("source_id"), F.col("name").alias("source"), "file_path", place, "imports")
    imports = source.select(*_SOURCE, "place", at).select(*_SOURCE, "place", "pos", F.col("i.module").alias("suffix"), F.col("i.name").alias("wanted"))
    defined = nodes.where("type <> 'import'").select(F.col("id").alias("target_id"), F.col("name").alias("target"), F.col("file_path").alias("target_file"), F.col("ord").alias("target_ord"))
    by_name = defined.withColumn("wanted", F.col("target"))
    stated = imports.join(index.withColumnRenamed("file_path", "target_file"), "suffix", "left").join(by_name, ["target_file", "wanted"], "left")
    stated = shared_table(stated, "stated")
    links = lambda df, sure: df.select(*_SOURCE, "place", *_TARGET, "target_ord", sure.alias("confidence"))
    direct = stated.where("target_id IS NOT NULL")
    rest = stated.where("target_id IS NULL")
    if rest.isEmpty():
        return links(direct, F.lit("high")), stated
    known = rest.where("target_file IS NOT NULL")
    named = nodes.where("type = 'import'").select(F.col("id").alias("to"), F.col("name").alias("wanted"), F.col("file_path").alias("target_file"))
    on = known.join(named, ["target_file", "wanted"]).where("source_id <> to").join(direct.select("source_id"), "source_id", "left_anti").select(F.col("source_id").alias("at"), "to", F.lit(False).alias("defines"))
    steps = direct.select(F.col("source_id").alias("at"), F.col("target_id").alias("to"), F.lit(True).alias("defines")).unionByName(on)
    high, medium = F.lit("high").alias("confidence"), F.lit("medium").alias("confidence")
    chained = shared_table(resolve.reexport_chain(steps).where("hops > 1").select(F.col("start").alias("source_id"), F.col("definition").alias("target_id"), high), "chained")
    exported = lookup.exports(nodes).select(F.col("file_path").alias("target_file"), F.col("name").alias("wanted"))
    star = known.where("wanted = '*'").select("source_id", "target_file").join(exported, "target_file").join(by_name, ["target_file", "wanted"]).select("source_id", "target_id", medium)
    found = direct.select("source_id").unionByName(chained.select("source_id"))
    lost = rest.where("wanted <> '*'").join(found, "source_id", "left_anti").select("source_id", "file_path", "wanted")
    # the first two files that define a name, a row a name that is looked for: one of them is another file
    by_file = by_name.join(lost.select("wanted").distinct(), "wanted", "left_semi").groupBy("wanted", "target_file").agg(F.min("target_id").alias("target_id"))
    first = by_file.groupBy("wanted").agg(F.min(F.struct("target_file", "target_id")).alias("x"))
    second = by_file.join(first, "wanted").where("target_file <> x.target_file").groupBy("wanted").agg(F.min(F.struct("target_file", "target_id")).alias("y"))
    guess = lost.join(first, "wanted").join(second, "wanted", "left")
    guess = guess.withColumn("t", F.when(F.col("x.target_file") != F.col("file_path"), F.col("x.target_id")).otherwise(F.col("y.target_id"))).where("t IS NOT NULL").groupBy("source_id").agg(F.min("t").alias("target_id")).withColumn("confidence", F.lit("medium"))
    more = chained.unionByName(star).unionByName(guess).groupBy("source_id", "target_id").agg(F.min("confidence").alias("confidence"))
    more = more.join(source.drop("imports"), "source_id").join(defined, "target_id")
    return shared_table(links(direct, high).unionByName(links(more, F.col("confidence"))), "imports"), stated


def named_edges(nodes: DataFrame) -> DataFrame:
    """(source_id, source, target_id, target, target_file, edge_type, confidence): what nodes refer to, resolved against all nodes at once.

    Imports first, then bases, calls, types and decorators. Calls and decorators try functions, then
    classes. A method that is found in no file that its receiver leads to is looked for in ancestors.
    A rank is tried on what those before it left, and names and files of both ends are carried along.
    """
    # what many ranks read is written once, so that no plan holds it many times over
    index = shared_table(resolve.module_index(nodes.groupBy("file_path").agg(F.min("ord").alias("ord"))), "modules")
    imp, stated = import_links(nodes, index)
    imported = imp.where("file_path <> target_file").groupBy("file_path").agg(F.collect_set("target_file").alias("known"))
    # by the targets of a name's first import, else by the module that it states
    said = stated.where("pos = 0 AND target_file IS NOT NULL").select("file_path", F.col("source").alias("receiver"), F.struct("place", F.lit(1).alias("by"), F.lit(0).cast("bigint").alias("target_ord"), "target_file").alias("x"))
    led = imp.select("file_path", F.col("source").alias("receiver"), F.struct("place", F.lit(0).alias("by"), "target_ord", "target_file").alias("x"))
    receivers = led.unionByName(said).groupBy("file_path", "receiver").agg(F.min("x").alias("x")).select("file_path", "receiver", "x.target_file")
    stop = sorted(vocab.builtin_names())
    defined = nodes.where("type <> 'import'")

    wanted = {"inherits": ("inherits", "class"), "calls": ("calls", "function"), "type_refs": ("uses_type", "class"), "decorators": ("decorated_by", "function")}
    refs = [nodes.select(F.col("id").alias("source_id"), F.col("name").alias("source"), "file_path", F.explode(F.array_distinct(column)).alias("name"), F.lit(edge).alias("edge_type"), F.lit(kind).alias("kind")) for column, (edge, kind) in wanted.items()]
    refs = reduce(DataFrame.unionByName, refs)
    refs = shared_table(refs.where(~F.col("name").isin(*stop)), "references")
    key = ["file_path", "name", "kind"]
    r = shared_table(refs.select(*key).distinct().join(imported, "file_path", "left"), "wanted")
    near = resolve.nearest(r, defined, receivers, index, stop)
    near = shared_table(r.select(*key).join(near, key, "left").select(*key, "x.rank", *[f"x.{c}" for c in _TARGET]), "nearest")
    ranked = lambda df, rank: df.select(*key, F.lit(rank).alias("rank"), *[f"x.{c}" for c in _TARGET])
    found = near.where("target_id IS NOT NULL")
    left = near.where("target_id IS NULL").select(*key)
    if not left.isEmpty():
        any_ = shared_table(left.join(resolve.anywhere(left, nodes), key, "left").select(*key, "x"), "anywhere")
        eleven = ranked(any_.where("x IS NOT NULL"), 11)
        dotted = left.where("kind = 'function' AND instr(name, '.') > 0")
        if not dotted.isEmpty():
            bases = refs.where("edge_type = 'inherits'").join(found.unionByName(eleven), key).where("target_id <> source_id").select("source_id", "target_id").distinct()
            nine = resolve.inherited(dotted, nodes, shared_table(bases, "bases"), stop)
            nine = nine.join(nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target"), F.col("file_path").alias("target_file")), "target_id")
            nine = shared_table(nine.select(*key, F.lit(9).alias("rank"), *_TARGET), "inherited")
            eleven = nine.unionByName(eleven.join(nine, key, "left_anti"))
            any_ = any_.join(nine, key, "left_anti")
        # what no rank takes for a function: a class
        again = any_.where("x IS NULL AND kind = 'function'").select("file_path", "name", F.lit("class").alias("kind")).join(imported, "file_path", "left")
        classes = resolve.nearest(again, defined.where("type = 'class'"), receivers, index, stop)
        classes = classes.select("file_path", "name", F.lit("function").alias("kind"), "x.rank", *[f"x.{c}" for c in _TARGET])
        found = found.unionByName(eleven).unionByName(classes)
    edges = refs.join(found, key).where("target_id <> source_id").select("source_id", "source", *_TARGET, "edge_type", resolve.confidence_of(F.col("rank")).alias("confidence"))
    edges = edges.unionByName(imp.select("source_id", "source", *_TARGET, F.lit("imports").alias("edge_type"), "confidence"))
    # of one edge by several names the surest
    sure = {"high": 0, "medium": 1, "low": 2}
    level = F.coalesce(*[F.when(F.col("confidence") == k, v) for k, v in sure.items()])
    edges = edges.groupBy("source_id", "source", *_TARGET, "edge_type").agg(F.min(level).alias("level"))
    return edges.select("source_id", "source", *_TARGET, "edge_type", F.coalesce(*[F.when(F.col("level") == v, k) for k, v in sure.items()]).alias("confidence"))


def edges_of(nodes: DataFrame) -> DataFrame:
    """``named_edges`` by the ids of both ends."""
    return named_edges(nodes).select("source_id", "target_id", "edge_type", "confidence")


@dataclass
class ChangePipeline:
    """Applies batches of versions (file_path, seq, content) to the state below ``path``."""

    spark: SparkSession
    path: str

    def _at(self, batch: int, name: str) -> str:
        return f"{self.path.rstrip('/')}/{batch:012d}/{name}"

    def last(self) -> int:
        """The last complete batch, -1 before the first."""
        try:
            r = self.spark.read.schema("batch bigint").json(f"{self.path.rstrip('/')}/_done").agg(F.max("batch")).first()
        except Exception:  # the folder is made by the first batch
            return -1
        return -1 if r is None or r[0] is None else int(r[0])

    def _read(self, batch: int, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._at(batch, name)) if batch >= 0 else self.spark.createDataFrame([], schema)

    def graph(self) -> Graph:
        k = self.last()
        return Graph(self._read(k, "nodes", NODES), self._read(k, "edges", EDGES))

    def ops(self) -> DataFrame:
        """The operations of all batches."""
        out = self.spark.createDataFrame([], OPS)
        return self.spark.read.schema(OPS).parquet(f"{self.path.rstrip('/')}/*/ops") if self.last() >= 0 else out

    def process(self, versions: DataFrame, batch: int) -> None:
        """For ``foreachBatch``: versions in order of seq; a batch that is done already is passed over."""
        before = self.last()
        if batch <= before:
            return
        entities = entities_of(versions)
        entities.write.mode("overwrite").parquet(self._at(batch, "new_entities"))
        new = self.spark.read.schema(ENTITY).parquet(self._at(batch, "new_entities"))
        old = self._read(before, "entities", ENTITY)
        v = versions.select("file_path", "seq", (F.trim("content") == "").alias("blank"))
        touched = v.select("file_path").distinct()
        # the last known version of each touched file stands before those of the batch
        prior = old.join(touched, "file_path", "left_semi")
        both = v.unionByName(prior.select("file_path", "seq").distinct().withColumn("blank", F.lit(False)))
        gate = delta.semantic_gate(both, prior.unionByName(new)).where("passes").join(v.select("file_path", "seq"), ["file_path", "seq"], "left_semi")
        passed = new.join(gate.select("file_path", "seq"), ["file_path", "seq"], "left_semi")
        kept = both.join(gate.select("file_path", "seq").unionByName(prior.select("file_path", "seq").distinct()), ["file_path", "seq"], "left_semi")
        d = delta.delta_rows(kept, prior.unionByName(passed)).join(gate.select("file_path", "seq"), ["file_path", "seq"], "left_semi")
        delta.op_feed(d).withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(self._at(batch, "ops"))
        newest = gate.groupBy("file_path").agg(F.max("seq").alias("seq"))
        now = old.join(newest.select("file_path"), "file_path", "left_anti").unionByName(new.join(newest, ["file_path", "seq"], "left_semi"))
        now.write.mode("overwrite").parquet(self._at(batch, "entities"))
        nodes_of(self.spark.read.schema(ENTITY).parquet(self._at(batch, "entities"))).write.mode("overwrite").parquet(self._at(batch, "nodes"))
        edges_of(self.spark.read.schema(NODES).parquet(self._at(batch, "nodes"))).write.mode("overwrite").parquet(self._at(batch, "edges"))
        self.spark.createDataFrame([(batch,)], "batch bigint").coalesce(1).write.mode("append").json(f"{self.path.rstrip('/')}/_done")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """A streaming query over versions; ``trigger`` as for writeStream, else all that is there now."""
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
