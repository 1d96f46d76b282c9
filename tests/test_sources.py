"""Sources: one small graph in every spelling that an export may use, and what breaks the rules; CSV folders; generators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from severa import __main__ as cli
from severa.functions import relations as rel
from severa.operators import instance as inst
from severa.operators import reach
from severa.operators.instance import InvalidInstance
from severa.sources import csv_graph, generators, json_graph

#: The graph that all spellings mean: type by node, and relations.
TYPES = {"ann": "User", "bob": "User", "pc1": "Computer", "ops": "Group", "top": "Group", "corp": "Domain"}
LINKS = [("ann", "ops", "MemberOf"), ("bob", "ops", "MemberOf"), ("ops", "pc1", "AdminTo"), ("pc1", "bob", "HasSession"), ("bob", "top", "WriteDacl"), ("top", "corp", "GenericAll"), ("corp", "ops", "Contains")]


def edges(found):
    return {(r.src, r.dst): r for r in found.edges.collect()}


def prices(found):
    return {k: (r.cost if r.deletable else None, tuple(r.etypes)) for k, r in edges(found).items()}


WANT = {(a, b): (rel.DEFAULT_COST[t], (t,)) for a, b, t in LINKS}


def save(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return f"file://{folder}/{name}"


def lists(rng):
    """Two lists under their names, ends under any of the keys, fields in any order."""
    keys = [("source", "target", "type"), ("src", "dst", "Kind"), ("from", "to", "rel"), ("SourceNodeId", "TargetNodeId", "RelationshipType")]
    out = []
    for a, b, t in LINKS:
        s, d, k = rng.choice(keys)
        fields = [(s, a), (d, b), (k, t), ("weight", 3)]
        rng.shuffle(fields)
        out.append(dict(fields))
    return json.dumps({"edges": out, "nodes": [{"type": t, "id": n} for n, t in TYPES.items()]}, indent=2)


def embedded(rng):
    """Records that hold their relations as fields of their own or of their properties, some as lists that point back."""
    records = []
    for n, t in TYPES.items():
        record = {"ObjectIdentifier": n, "Type": t, "Properties": {"name": n.upper()}}
        for a, b, k in LINKS:
            if k == "MemberOf" and b == n:
                record["Properties"].setdefault("Members", []).append(a if rng.random() < 0.5 else {"ObjectIdentifier": a})
            elif k == "AdminTo" and b == n:
                record.setdefault("Local-Admins", []).append({"id": a})
            elif a == n and k not in ("MemberOf", "AdminTo"):
                record.setdefault(k, []).append(b)
        records.append(record)
    rng.shuffle(records)
    return json.dumps({"data": records})


def lines(rng):
    """A record a line: nodes with labels, relationships whose ends are objects, blank lines between."""
    out = [{"type": "node", "id": n, "labels": ["Base", t], "properties": {"name": n}} for n, t in TYPES.items()]
    out += [{"type": "relationship", "label": t, "start": {"id": a, "labels": ["Base"]}, "end": {"id": b}} for a, b, t in LINKS]
    rng.shuffle(out)
    return "\n".join(json.dumps(x) + "\n" * rng.randint(0, 1) for x in out)


def mixed(rng):
    """One array of nodes and relations; numbers as ids would do too, spellings vary."""
    spelt = {"MemberOf": ["member_of", "Member Of"], "AdminTo": ["admins", "LocalAdmin"], "HasSession": ["sessions"], "WriteDacl": ["WRITEDACL"]}
    out = [{"name": n, "kind": f"Base{t}"} for n, t in TYPES.items()]
    out += [{"start": a, "end": b, "Relationship": rng.choice(spelt.get(t, [t]))} for a, b, t in LINKS]
    rng.shuffle(out)
    return json.dumps(out)


@pytest.mark.parametrize("spelling", [lists, embedded, lines, mixed])
def test_one_graph_in_every_spelling(spark, tmp_path, spelling, seed=1):
    path = save(tmp_path / "in", f"export.{'jsonl' if spelling is lines else 'json'}", spelling(random.Random(seed)))
    got = json_graph.load(spark, path, entry_weight={"ann": 1.5}, target_value={"corp": 4})
    assert prices(got.instance) == WANT
    assert {r.node: r.ntype for r in got.instance.nodes.collect()} == TYPES
    assert reach.risk(inst.indexed(got.instance)).first().risk == 6.0
    assert got.statistics["unknown_relation_types"] == {} and got.statistics["nodes"] == 6 and got.statistics["relations"] == 7


def load(spark, folder, records, **given):
    return json_graph.load(spark, save(folder, "export.json", "\n".join(json.dumps(r) for r in records)), **given)


def test_parts_of_a_folder_are_one_graph(spark, tmp_path):
    save(tmp_path, "a.json", json.dumps({"nodes": [{"id": n, "type": t} for n, t in TYPES.items()]}))
    save(tmp_path, "b.jsonl", "\n".join(json.dumps({"src": a, "dst": b, "rel": t}) for a, b, t in LINKS))
    save(tmp_path, "notes.txt", "no export")
    got = json_graph.load(spark, f"file://{tmp_path}")
    assert prices(got.instance) == WANT and got.statistics["files"] == 2


def test_records_of_one_node_are_merged(spark, tmp_path):
    """Later records fill in and correct earlier ones; blank ids and records without one are skipped."""
    records = [{"id": "x", "type": "User", "name": "first"}, {"id": "x", "name": "second"}, {"id": " "}, {"type": "User"}, {"source": "x", "target": "", "type": "Owns"}, {"source": "x", "target": "y", "type": "Owns"}]
    got = load(spark, tmp_path, records)
    told = {r.node: r for r in got.instance.nodes.collect()}
    assert told["x"].name == "second" and told["y"].ntype == "Other" and ("x", "y") in edges(got.instance)
    assert got.statistics["skipped_records"] >= 1


def test_annotations_of_files_and_callers(spark, tmp_path):
    records = [{"id": "a", "type": "User", "entry_weight": 2}, {"id": "b", "type": "Group", "properties": {"target_value": 5, "highvalue": True}}, {"id": "c", "type": "Group", "tier0": "yes"}, {"source": "a", "target": "b", "type": "Owns"}, {"source": "c", "target": "b", "type": "Owns"}]
    own = load(spark, tmp_path, records).instance
    assert [tuple(r) for r in own.entries().collect()] == [("a", 2.0)] and [tuple(r) for r in own.targets().collect()] == [("b", 5.0)]
    assert edges(own)["a", "b"].deletable and not edges(own)["c", "b"].deletable  # a source of tier 0 is fixed, high value isn't tier 0
    given = load(spark, tmp_path, records, entry_weight={"c": 1}, target_value={}, tier0=["a"], wellknown={"b": "everyone"}).instance
    assert [tuple(r) for r in given.entries().collect()] == [("c", 1.0)] and given.targets().count() == 0
    assert not edges(given)["a", "b"].deletable and edges(given)["c", "b"].deletable
    for wrong in ({"tier0": ["zz"]}, {"wellknown": {"a": "NOBODY"}}, {"entry_weight": {"a": 1}, "target_value": {"a": 1}}):
        with pytest.raises(InvalidInstance):
            load(spark, tmp_path, records, **wrong)


def test_membership_of_default_groups_is_fixed(spark, tmp_path):
    groups = dict(zip("abcdef", rel.FIXED_MEMBERSHIP_GROUPS))
    records = [{"id": "u", "type": "User", "primary_group": "p"}, *({"id": g, "type": "Group"} for g in groups)] + [{"source": "u", "target": t, "type": k} for t in (*groups, "p", "q") for k in ("MemberOf", "Owns")]
    got = edges(load(spark, tmp_path, records, wellknown=groups).instance)
    assert [got["u", x].deletable for x in "abcdefpq"] == [False] * 7 + [True] and got["u", "a"].etypes == ["MemberOf", "Owns"]


def test_both_replication_rights_are_one_relation(spark, tmp_path):
    rights = [("a", "GetChanges"), ("a", "get-changes-all"), ("a", "GetChanges"), ("b", "GetChanges"), ("c", "GetChangesAll"), ("c", "Owns")]
    got = load(spark, tmp_path, [{"src": s, "dst": "d", "rel": k} for s, k in rights])
    assert prices(got.instance) == {("a", "d"): (2, ("DCSync",)), ("c", "d"): (2, ("Owns",))}
    assert got.statistics["dcsync_pairs"] == 1 and got.statistics["incomplete_replication_pairs"] == 2


def test_unknown_names(spark, tmp_path):
    """A relation of an unknown name is kept under it; a list under one is, if the name looks like a relation."""
    records = [{"src": "a", "dst": "b", "rel": "Befriends"}, {"id": "a", "type": "User", "CanKnock": ["c"], "Shoes": ["d"], "plain": "e"}]
    got = load(spark, tmp_path, records)
    assert prices(got.instance) == {("a", "b"): (rel.OTHER_COST, ("Befriends",)), ("a", "c"): (rel.OTHER_COST, ("CanKnock",))}
    assert got.statistics["unknown_relation_types"] == {"Befriends": 1, "CanKnock": 1} and got.statistics["skipped_relation_types"] == {"Shoes": 1}


def test_a_line_that_is_no_json_is_named(spark, tmp_path):
    path = save(tmp_path, "broken.jsonl", '{"id": "a"}\n\n{"id": \n')
    with pytest.raises(Exception, match="broken.jsonl:3"):
        json_graph.load(spark, path)


# ---------------------------------------------------------------- CSV folders


def test_csv_folder(spark, tmp_path):
    """Random rows merged by the rules' own words; saved and loaded again, they stay."""
    rng = random.Random(3)
    rows = [(rng.choice("abcd"), rng.choice("abcd"), rng.choice(["1", "2.9", " 7 "]), rng.choice(["1", "TRUE", " y", "0", "no", ""])) for _ in range(60)]
    save(tmp_path, "edges.csv", "deletable,src,cost,dst\n" + "\n".join(f"{f}, {a} ,{c},{b}" for a, b, c, f in rows))
    save(tmp_path, "nodes.csv", "node,entry_weight,target_value,colour\na,2,,red\n d,,3.5,\nalone,,,\na,1,,\n")
    save(tmp_path, "meta.json", '{"made": "here"}')
    want = {}
    for a, b, c, f in rows:
        if a != b:
            cost, free, n = want.get((a, b), (0, True, 0))
            yes = f.strip().lower() in ("1", "true", "y")
            want[a, b] = (cost + (int(float(c)) if yes else 0), free and yes, n + 1)
    i = csv_graph.load(spark, f"file://{tmp_path}")
    assert {k: (r.cost, r.deletable, r.multiplicity) for k, r in edges(i).items()} == {k: (c if f else None, f, n) for k, (c, f, n) in want.items()}
    assert {r.node: (r.entry_weight, r.target_value) for r in i.nodes.collect()} == {"a": (2, 0), "b": (0, 0), "c": (0, 0), "d": (0, 3.5), "alone": (0, 0)}
    csv_graph.save(i, f"file://{tmp_path}/again")
    j = csv_graph.load(spark, f"file://{tmp_path}/again")
    assert j.meta == {"made": "here"} and {k: (r.cost, r.deletable) for k, r in edges(j).items()} == {k: (r.cost, r.deletable) for k, r in edges(i).items()}
    assert sorted(map(tuple, j.nodes.collect())) == sorted(map(tuple, i.nodes.collect()))


@pytest.mark.parametrize("edge, node", [("a,b,-1,1", "a,1,"), ("a,b,0.4,1", "a,1,"), ("a,b,3,1", "b,1,2"), ("a,b,3,1", "b,,-2")])
def test_csv_that_breaks_a_rule(spark, tmp_path, edge, node):
    save(tmp_path, "edges.csv", f"src,dst,cost,deletable\n{edge}\n")
    save(tmp_path, "nodes.csv", f"node,entry_weight,target_value\n{node}\n")
    with pytest.raises(InvalidInstance):
        csv_graph.load(spark, f"file://{tmp_path}")


def test_no_folder(spark, tmp_path):
    with pytest.raises(InvalidInstance, match="edges.csv"):
        csv_graph.load(spark, f"file://{tmp_path}/nothing")


def test_mapping_files(spark, tmp_path):
    path = save(tmp_path, "m.txt", "#all\nx y , 4\n\nz\t0.5 # half\nplain\n")
    assert {r.node: r.value for r in csv_graph.mapping(spark, path, 9).collect()} == {"x y": 4.0, "z": 0.5, "plain": 9.0}
    path = save(tmp_path, "m.json", '{"k": 3, "l": 0.25}')
    assert {r.node: r.value for r in csv_graph.mapping(spark, path, 9).collect()} == {"k": 3.0, "l": 0.25}


# ---------------------------------------------------------------- generators


@pytest.mark.parametrize("mean", [0.5, 5, 100, 800])
def test_poisson_has_its_mean_and_variance(spark, mean):
    n = 20_000
    drawn = spark.range(n).select(generators.poisson(mean, generators.uniform(5, F.col("id"))).alias("k"))
    got = drawn.agg(F.avg("k").alias("mean"), F.var_samp("k").alias("var"), F.max("k").alias("most")).first()
    assert abs(got.mean - mean) < 5 * (mean / n) ** 0.5 and abs(got["var"] / mean - 1) < 0.08 and got.most > mean + 2.5 * mean**0.5


def test_poisson_by_its_sums(spark):
    u = [0.0, 0.13, 0.14, 0.40, 0.41, 0.9999, 1 - 2.0**-40]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in u], "u double").select(generators.poisson(2.0, F.col("u"))).collect()]
    assert got[:5] == [0, 0, 1, 1, 2] and got[5] == 9 and 15 < got[6] < 30
    assert spark.range(1).select(generators.poisson(0, F.lit(0.9))).first()[0] == 0


def test_seed_lists():
    assert generators.seeds_of(" 3-6 ") == [3, 4, 5, 6] and generators.seeds_of("7,2") == [7, 2]


def test_typed_graphs(spark):
    c = generators.Config(users=150, groups=40, computers=60, targets=2, seed=9, membership_fraction=0.5)
    one, two, other = (inst.validated(generators.typed(spark, x)) for x in (c, c, generators.Config(**{**c.__dict__, "seed": 10})))
    assert prices(one) == prices(two) != prices(other)
    member = one.edges.where("array_contains(etypes, 'MemberOf') and src like 'user%' and dst like 'group-0%'")
    per_user = member.groupBy("src").count().agg(F.avg("count")).first()[0]
    assert 6 < per_user < 20  # half of the groups drawn, of one branch, without repeats
    assert one.entries().count() == 15 and one.targets().count() == 2 and reach.risk(inst.indexed(one)).first().risk > 0
    assert all(not r.deletable for r in edges(one).values() if r.src.startswith("tier0") or "Contains" in r.etypes)


@pytest.mark.parametrize("wrong", [{"groups": 0}, {"targets": 0}, {"entry_fraction": 1.5}, {"admin_degree": -1}, {"gate_count": 1}])
def test_settings_that_break_a_rule(wrong):
    with pytest.raises(ValueError):
        generators.Config(**wrong).validated()


def test_layered_and_two_routes(spark):
    i = inst.validated(generators.layered(spark, 250, 4))
    assert reach.risk(inst.indexed(i)).first().risk > 0 and {r.cost for r in i.edges.collect()} <= {None, 1, 2, 3, 5}
    wide = generators.layered(spark, 400, 4, out_degree=40.0).edges.groupBy("src").count().agg(F.max("count")).first()[0]
    assert wide > 64
    ring = spark.createDataFrame([(k, (k + 1) % 5) for k in range(5)] + [(2, 2)], "a int, b int")
    g = inst.indexed(inst.validated(generators.two_routes(ring)))
    assert reach.risk(g).first().risk == 5
    assert {r.gain for r in reach.scenario_gains(g, g.edges.where("deletable")).collect()} == {0.0}


def policy_export():
    nodes = [("corp", "Domain", "CORP", "DC=CORP", None, None), ("da", "Group", "Domain Admins@CORP", "CN=x,OU=T0 Groups,DC=CORP", None, None), ("du", "Group", "Domain Users@CORP", "", None, None), ("dc1", "Computer", "DC1@CORP", "CN=DC1,OU=Domain Controllers,DC=CORP", None, None)]
    nodes += [(f"u{k}", "User", f"U{k}@CORP", f"CN=U{k},OU=T2 Enabled Users,DC=CORP", k % 2 == 0, k % 10 == 0) for k in range(60)]
    out = [{"type": "node", "id": i, "labels": ["Base", t], "properties": {"name": n, "distinguishedname": d, "enabled": e, "admincount": a}} for i, t, n, d, e, a in nodes]
    out += [{"type": "relationship", "label": "MemberOf", "start": {"id": f"u{k}"}, "end": {"id": "du" if k % 3 else "da"}} for k in range(60)]
    return out + [{"type": "relationship", "label": "GenericAll", "start": {"id": "da"}, "end": {"id": "corp"}}]


def test_prepare(spark, tmp_path):
    path = save(tmp_path, "org.jsonl", "\n".join(map(json.dumps, policy_export())))
    row = generators.prepare(spark, path, f"file://{tmp_path}/out", 4)
    assert (row["dataset"], row["entries"], row["targets"], row["n"]) == ("org_s4", 2, 2, 64)
    made = csv_graph.load(spark, f"file://{tmp_path}/out/org_s4")
    chosen = [r.node for r in made.entries().collect()]
    assert all(int(x[1:]) % 2 == 0 and int(x[1:]) % 10 for x in chosen) and {r.node for r in made.targets().collect()} == {"corp", "da"}
    e = edges(made)
    assert not e["u1", "du"].deletable and not e["da", "corp"].deletable and e["u3", "da"].deletable
    assert made.meta["seed"] == 4 and len(made.meta["sha256"][0]) == 64
    cli.main(["prepare", f"{tmp_path}/org.jsonl", "--seeds", "4", "--out", f"{tmp_path}/cli"])
    manifest = spark.read.option("header", True).csv(f"file://{tmp_path}/cli/manifest.csv").first()
    assert manifest.dataset == "org_s4" and manifest.edges_sha256 == row["edges_sha256"]
    save(tmp_path, "bare.json", '{"nodes": [{"id": "a", "type": "User"}]}')
    with pytest.raises(InvalidInstance):
        generators.prepare(spark, f"file://{tmp_path}/bare.json", f"file://{tmp_path}/out", 1)


def test_lines_are_read_in_ranges(spark, tmp_path):
    """Lines of large files keep their numbers in the file, a value over several lines is one, and no whole file is a row."""
    path = save(tmp_path / "in", "a.jsonl", "\n".join(json.dumps({"id": f"x{i}", "type": "User"}) + "\n" * (i % 3) for i in range(300)))
    save(tmp_path / "in", "b.json", json.dumps({"id": "y", "type": "Group"}, indent=2))
    save(tmp_path / "in", "c.json", "\n" + json.dumps([{"id": "z", "type": "Group"}]) + "\n")
    text = (tmp_path / "in" / "a.jsonl").read_text()
    want = {("a.jsonl", i + 1) for i, x in enumerate(text.split("\n")) if x} | {("b.json", 0), ("c.json", 0)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        found = json_graph.payloads(spark, f"file://{tmp_path}/in")
        assert {(r.file, r.line) for r in found.select("file", "line").collect()} == want and found.count() == len(want)
        with open(path.removeprefix("file://"), "a") as f:
            f.write("\n\nno JSON\n")
        with pytest.raises(Exception, match=rf"no JSON at:a.jsonl:{text.count(chr(10)) + 3}"):
            json_graph.payloads(spark, f"file://{tmp_path}/in").select("v").write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # the lines come from ranges of the file: a row of a whole file would hold them all
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
