"""The programs over a user's own files, from JSON lines to a ranked run."""

import json
import random

from trawler import cli
from trawler.sources import readers


def test_from_corpus_to_run(spark, tmp_path, capsys):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(60)]
    docs = [{"id": f"d{i:03d}", "title": f"{rng.choice(words)} {rng.choice(words)}", "text": " ".join(rng.choices(words, k=30)), "keywords": [rng.choice(words)]} for i in range(80)]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, docs)))
    queries = {f"q{i}": f"{words[i]} {words[i + 20]}" for i in range(8)}
    (tmp_path / "q.csv").write_text("QueryId,Query\n" + "".join(f"{q},{t}\n" for q, t in queries.items()))
    good = [(q, d["id"]) for q, t in queries.items() for d in docs if t.split()[0] in d["text"].split()]
    (tmp_path / "r.csv").write_text("q,d,rel\n" + "".join(f"{q},{d},1\n" for q, d in good))

    def call(line: str) -> list[dict]:
        a = cli.parser().parse_args([x.replace("@", str(tmp_path)) for x in line.split()])
        a.run(spark, a)
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    files = "-c @/c.jsonl -q @/q.csv --qrels @/r.csv"
    stats = call("index -c @/c.jsonl -i @/idx")[0]
    assert stats["Number of Lists"] == 60 and stats["Index Size"] > 0
    call("encode -i @/c.jsonl -q @/q.csv -o @/vec --dim 32")
    call("encode -i @/c.jsonl -q @/q.csv -o @/wide --dim 128")
    call("retrieve --vectors @/vec -o @/cands -k 5")
    found = readers.read_dense_candidates(spark, f"{tmp_path}/cands", 5).toPandas()
    assert len(found) == 40 and sorted(found.dense_rank.unique()) == [1, 2, 3, 4, 5]
    call(f"extract --version v4 {files} -o @/v4")
    v4 = readers.read_features(spark, f"{tmp_path}/v4")
    assert "f_bm25" in v4.columns and v4.where("relevance > 0").count() == len(good)
    call(f"extract --version hybrid {files} --vectors @/vec -o @/hybrid")
    call("add-dense -i @/hybrid -o @/two --dense @/vec:f_again @/wide:f_wide")
    two = readers.read_features(spark, f"{tmp_path}/two").toPandas()
    assert (abs(two.f_again - two.f_dense_sim) < 1e-6).all() and two.f_wide.nunique() > 5
    call("interaction -i @/two -o @/three")
    call("add-ce -i @/three -c @/c.jsonl -q @/q.csv -o @/four")
    table = readers.read_features(spark, f"{tmp_path}/four")
    assert {"f_dense_rank", "f_dense_z", "f_ce", "f_wide"} <= set(table.columns) and table.count() == len(two)
    call('train -i @/four -o @/model --val-fraction 0.25 --seeds 1 --params {"min_data_in_leaf":5,"num_rounds":20}')
    call("predict -i @/four --model @/model -o @/run")
    assert call("ndcg --submission @/run --qrels @/r.csv")[0]["ndcg"] > 0.8
    rows = {r["pool"]: r for r in call("recall --qrels @/r.csv --runs a=@/run b=@/run --cuts 5 1000")}
    assert set(rows) == {f"{n}@{k}" for n in ("a", "b", "union") for k in (5, 1000)} and rows["union@1000"]["mean_recall"] == 1.0 > rows["a@5"]["mean_recall"]
    call("extract --version v6 -c @/c.jsonl -q @/q.csv -o @/test")
    assert readers.read_features(spark, f"{tmp_path}/test").where("relevance > 0").count() == 0
