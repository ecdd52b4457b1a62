import random
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from telar.llm.event_clusters import event_clusters, headline, pivot_clusters, slip, spellings


def groups(rows, id="id", name="cluster"):
    out = defaultdict(set)
    for r in rows:
        out[r[name]].add(r[id])
    return sorted(map(sorted, out.values()))


OTHERS = {
    "Corte de agua en {p} afecta a {n} familias, informa el Consejo": "agua", "Unas {n} familias de {p} siguen sin agua por una avería": "agua", "Avería deja sin agua potable a {n} familias de {p}": "agua",
    "Incendio forestal en {p} consume {n} hectáreas": "fuego", "Bomberos combaten el incendio de {p}, que ya quemó {n} hectáreas": "fuego",
}


def background(events=60, seed=3):
    """Headlines of other events, from which a word's frequency is learnt."""
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(4)).capitalize()
    rows = {}
    for i in range(events):
        place, kind, n = rng.choice(["Boca de ", "Villa ", "Isla "]) + name(), rng.choice(["agua", "fuego"]), rng.randrange(100, 9000)
        rows |= {f"o{i}-{j}": t.format(p=place, n=n) for j, t in enumerate(t for t, k in OTHERS.items() if k == kind)}
    return rows


def test_events(spark):
    titles = {
        "a1": "Corte de agua en Boca de Tremiso afecta a 3.520 familias, informa el Consejo", "a2": "Unas 4.000 familias de Boca de Tremiso siguen sin agua por una avería",
        "a3": "Avería deja sin agua potable a 3.520 familias de Boca de Tremio (fotos)", "a4": "CORTE DE AGUA EN BOCA DE TREMISO AFECTA A 3.520 FAMILIAS, INFORMA EL CONSEJO",
        "b1": "Incendio forestal en Boca de Tremiso consume 77 hectáreas", "b2": "Bomberos combaten el incendio de Boca de Tremiso, que ya quemó 77 hectáreas",
        "c1": "Corte de agua en Boca de Lagurri afecta a 3.520 familias, informa el Consejo", "d1": "Sin lugar ni cifra", "e1": None, "f1": "…",
    }
    rows = {**titles, **background()}
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in [*rows.items(), *rows.items()]], "id_noticia string, titulo string, cluster string, size string")
    found = event_clusters(df, "id_noticia", "titulo").collect()
    own = [r for r in found if r.id[0] != "o"]
    assert groups(own) == [["a1", "a2", "a3", "a4"], ["b1", "b2"], ["c1"], ["d1"]]
    assert {r.size for r in own if r.id.startswith("a")} == {4} and all(r.typical in rows.values() for r in found)
    assert groups(r for r in found if r.id[0] == "o") == groups({"id": k, "cluster": k.split("-")[0]} for k in rows if k[0] == "o")


def test_one_event_of_a_third_of_all_headlines(spark):
    """Its name is as frequent as the words that say what happened, but its headlines agree on a figure."""
    rng = random.Random(8)
    rows = background(60)
    ways = [t for t, k in OTHERS.items() if k == "agua"]
    rows |= {f"h-{i}": ways[i % 3].format(p="Isla Romeluda", n=812) + rng.choice(["", f", {i} veces", f" y {i} más"]) for i in range(80)}
    df = spark.createDataFrame(list(rows.items()), "id string, titulo string")
    found = groups(r for r in event_clusters(df, "id", "titulo").collect())
    assert found == groups({"id": k, "cluster": k.split("-")[0]} for k in rows)


def test_headlines_without_names(spark):
    """No names, no figures, and one word that all have: headlines of mostly the same words are one group."""
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in ("per", "tal", "mon", "ris") for b in ("ba", "du", "ne") for c in ("lo", "ma", "sa")]
    topics = [rng.sample(words, 8) for _ in range(40)]
    rows = [(f"t{i}-{j}", " ".join(["siempre", *rng.sample(t, 8)][: 9 - j % 2])) for i, t in enumerate(topics) for j in range(6)]
    found = event_clusters(spark.createDataFrame(rows, "id string, titulo string"), "id", "titulo").collect()
    got = {r.id: r.cluster for r in found}
    same = lambda i: i.split("-")[0]
    hits = [(same(a) == same(b), got[a] == got[b]) for a, b in combinations(sorted(got), 2)]
    both = sum(x and y for x, y in hits)
    assert len(got) == 240 and both >= 0.9 * sum(x for x, _ in hits) and both >= 0.95 * sum(y for _, y in hits)


def test_empty_and_long(spark):
    df = spark.createDataFrame([("a", "palabra " * 30_000), ("b", "palabra " * 30_000)], "id string, titulo string")
    assert groups(event_clusters(df, "id", "titulo").collect()) == [["a", "b"]]
    assert event_clusters(df.limit(0), "id", "titulo").count() == 0


def test_pivots_against_the_sequential_algorithm(spark):
    """With complete blocks each round is the next pivot of the sequential order."""
    rng = random.Random(5)
    points = [(i, rng.randrange(1000), rng.random()) for i in range(80)]
    near = lambda a, b: 1.0 - F.abs(a["x"] - b["x"])
    df = spark.createDataFrame(points, "id long, order long, x double").select("id", "order", F.array(F.lit(1).cast("long")).alias("keys"), F.struct("x").alias("f"))
    got = {r.id: r.pivot for r in pivot_clusters(df, near, 0.9).collect()}
    want, left = {}, sorted(points, key=lambda p: (p[1], p[0]))
    while left:
        p = left[0]
        members = [q for q in left if 1 - abs(q[2] - p[2]) >= 0.9]
        want |= {q[0]: p[0] for q in members}
        left = [q for q in left if q not in members]
    assert got == want


def test_no_row_is_left_after_the_single_rounds(spark):
    """Blocks of more dissimilar rows than rounds: every row gets the pivot of the sequential order."""
    rng = random.Random(6)
    points = [(i, rng.randrange(1000), rng.random(), [0] if i % 3 else rng.sample(range(1, 6), rng.randrange(3))) for i in range(150)]
    near = lambda a, b: 1.0 - F.abs(a["x"] - b["x"])
    df = spark.createDataFrame(points, "id long, order long, x double, keys array<long>").select("id", "order", "keys", F.struct("x").alias("f"))
    got = {r.id: r.pivot for r in pivot_clusters(df, near, 0.98, 0).collect()}
    want: dict[int, int] = {}
    for i, _, x, keys in sorted(points, key=lambda p: (p[1], p[0])):
        want[i] = next((j for j in want.values() if set(keys) & set(points[j][3]) and 1 - abs(x - points[j][2]) >= 0.98), i)
    assert got == want
    after = {r.id: r.pivot for r in pivot_clusters(df, near, 0.98, 2).collect()}
    assert set(after) == set(want) and set(after.values()) == set(want.values())
    apart = df.withColumns({"keys": F.array(F.lit(1).cast("long")), "f": F.struct(F.col("id").cast("double").alias("x"))})
    assert all(r.id == r.pivot for r in pivot_clusters(apart, near, 0.98, 2).collect()) and pivot_clusters(apart, near, 0.98, 2).count() == 150


def test_spellings_meet(spark):
    base = "trumelite"
    words = [base, "trumeliet", "trumellite", "trumelte", "trumelit", "trumovite", "ab"]
    got = {r.w: (set(r.s), r.same) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", spellings(F.col("w")).alias("s"), slip(F.col("w"), F.lit(base)).alias("same")).collect()}
    assert all(got[base][0] & got[w][0] and got[w][1] for w in words[1:5])
    assert not got[base][0] & got["trumovite"][0] and not got["trumovite"][1] and got["ab"][0] == {"ab"}
    h = headline("&quot;Isla Bonita&quot;: 1.250 casas y 3,5 metros")
    assert h["words"] == ["bonita", "casas", "isla", "metros"] and h["figures"] == [3.5, 1250.0] and 1000.0 in h["rounded"] and h["form"] == "isla bonita 1 250 casas y 3 5 metros"


def test_pairs_query_has_no_pair_twice(spark, tmp_path):
    from telar.llm.queries import p5_found

    rows = [(f"n{i}", f"Festival de Villa Roja espera {300 + i % 2 * 0} turistas este fin de semana" + " (fotos)" * (i % 2)) for i in range(5)]
    spark.createDataFrame(rows, "id_noticia string, titulo string").write.parquet(str(tmp_path / "hoja_preetiquetado.parquet"))
    got = sorted((r.id_a, r.id_b) for r in p5_found(spark, str(tmp_path)).collect())
    assert got == sorted(combinations([f"n{i}" for i in range(5)], 2))
