import ast
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gleaner.plans import commands
from gleaner.sources import files, sheets

ROOT = Path(__file__).resolve().parent.parent


def make_xlsx(path, book):
    """A minimal workbook: shared strings for odd rows, inline ones for even rows."""
    shared: list[str] = []
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="r{k + 1}"/>' for k, n in enumerate(book))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{sheets._MAIN[1:-1]}" xmlns:r="{sheets._REL[1:-1]}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k + 1}" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(book))) + "</Relationships>")
        for k, rows in enumerate(book.values()):
            out = []
            for r, cells in enumerate(rows):
                row = ""
                for c, v in enumerate(cells):
                    ref = f"{chr(65 + c)}{r + 1}"
                    if v is None:
                        continue
                    if isinstance(v, (int, float)):
                        row += f'<c r="{ref}"><v>{v}</v></c>'
                    elif r % 2:
                        shared.append(v)
                        row += f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
                    else:
                        row += f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
                out.append(f'<row r="{r + 1}">{row}</row>')
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f'<worksheet xmlns="{sheets._MAIN[1:-1]}"><sheetData>{"".join(out)}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{sheets._MAIN[1:-1]}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")


@pytest.fixture
def workbook(tmp_path):
    path = str(tmp_path / "book.xlsx")
    head = ["id", "query", "Primary GT", "Acceptable GT", "Hard Negative", "처리 의도"]
    make_xlsx(path, {
        "FAQ": [["FAQ ID", "category", "question"], ["F1", "x", "reset the password"], ["F2", "x", "change the plan"], [None, "x", "no id"], ["F1", "x", "reset my password"]],
        "Easy": [head, ["T1", "password reset", "F1", None, "F2", "FAQ_RAG"], ["T2", "plan change", "F2;F1", "F1", None, None], ["T3", "other", "F1", None, None, "MAP_API"], [None, "no id", "F1"]],
        "Hard": [["id", "query", "Primary GT"], ["T9", "the plan", "F2"]],
    })
    return path


def test_xlsx_both_ways(spark, workbook):
    one = sheets.read_xlsx(spark, workbook, "FAQ", 3, 1)
    assert [tuple(r) for r in one.orderBy("pos").collect()][:2] == [(1, "F1", "x", "reset the password"), (2, "F2", "x", "change the plan")]
    spark.dataSource.register(sheets.XlsxDataSource)
    two = spark.read.format("xlsx").option("path", workbook).option("sheet", "FAQ").option("skip", 1).option("columns", 3).load()
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)
    with pytest.raises(Exception, match="no sheet"):
        sheets.read_xlsx(spark, workbook, "Nope").collect()


def test_corpus_and_query_sheets(spark, workbook):
    raw = sheets.read_xlsx(spark, workbook, "FAQ", 3, 1).select(F.col("c0").alias("faq_id"), F.col("c2").alias("question"), "pos")
    assert [tuple(r) for r in sheets.faq_corpus(raw).orderBy("pos").collect()] == [("F1", 1, "reset my password"), ("F2", 2, "change the plan")]
    said = []
    got = sheets.query_workbook(spark, workbook, {"Easy": "E", "Hard": "H", "Gone": "G"}, warn=said.append)
    assert said == ["no sheet 'Gone'"]
    rows = {r.test_id: (r.category, r.gt_ids, r.acceptable_ids, r.hard_neg_ids) for r in got.collect()}
    assert rows == {"T1": ("E", ["F1"], ["F1"], ["F2"]), "T2": ("E", ["F2", "F1"], ["F1"], []), "T9": ("H", ["F2"], ["F2"], [])}


def test_csv(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    Path(path).write_text('﻿id,question\n1," two\nlines, ""quoted"" "\n,blank id\n3,\n', encoding="utf-8")
    df = files.read_text_csv(spark, path)
    assert df.columns == ["id", "question"]
    assert [tuple(r) for r in df.collect()] == [("1", ' two\nlines, "quoted" '), ("", "blank id"), ("3", "")]
    assert [r.id for r in files.read_questions(spark, path).collect()] == ["1"]
    assert [tuple(r) for r in files.read_positional_csv(spark, path).limit(1).collect()] == [("1", ' two\nlines, "quoted" ')]
    files.write_csv(df, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid,question")
    again = files.read_text_csv(spark, str(tmp_path / "out"))
    assert [tuple(r) for r in again.collect()] == [tuple(r) for r in df.collect()]
    Path(tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="no rows"):
        files.read_positional_csv(spark, str(tmp_path / "empty.csv"))


def test_json_lock_and_digest(spark, tmp_path):
    Path(tmp_path / "w.json").write_text('{"a": {"b": 1}}')
    assert files.read_json(spark, str(tmp_path / "w.json")) == {"a": {"b": 1}}
    assert len(files.file_digest(spark, str(tmp_path / "w.json"))) == 16
    one = spark.range(1)
    files.write_once(one, str(tmp_path / "once"))
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        files.write_once(one, str(tmp_path / "once"))


def lab_files(tmp_path):
    """60 questions whose gold scores high and whose others score low."""
    labels, cands, sents, need = ["id,question,intended_group,expression_type,final_label,final_gold_faq_ids"], ["qid,rank,faq_id,variant_id,similarity,intent,faq_question,variant_question"], ["qid,faq_id,sentence_idx,similarity,sentence"], ["qid,faq_id,sentence_idx,needed"]
    for k in range(60):
        answer = k % 3 != 0
        labels.append(f"Q{k},text {k},{'ANS' if answer else 'OFF'},NORMAL,{'ANSWER' if answer else 'NO_ANSWER'},{'F1' if answer else ''}")
        for r in range(1, 5):
            top = answer and r == 1
            cands.append(f"Q{k},{r},F{r},V,{0.85 if top else 0.5 - r / 100 + k / 1000},FAQ_RAG,q,v")
            for s in range(3):
                sents.append(f"Q{k},F{r},{s},{0.8 if top and s < 2 else 0.45},s{s}")
                need.append(f"Q{k},F{r},{s},{'Y' if s < 2 else 'N'}")
    for name, lines in (("labels", labels), ("candidates", cands), ("sentences", sents), ("need", need)):
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "faq_catalog.csv").write_text("faq_id,intent,question,answer\nF1,x,q,an  answer\n")


def test_dev_and_final(spark, tmp_path):
    lab_files(tmp_path)
    data, out = str(tmp_path), str(tmp_path / "out")
    picks = commands.dev(spark, f"{data}/labels.csv", data, out, f"{data}/need.csv", draws=50, t1=(0.5, 0.9, 0.05), t2=(0.4, 0.9, 0.1))
    got = {r.profile: (r.t1, r.t2) for r in picks.collect()}
    assert set(got) == {"balanced", "conservative", "responsive"} and all(0.5 <= a <= 0.85 and 0.4 <= b <= 0.8 for a, b in got.values())
    assert all((tmp_path / "out" / n).exists() for n in ("grid_dev", "t1_view", "t2_view", "dev_report", "dev_candidates"))
    scores = commands.final(spark, f"{data}/labels.csv", data, out, [(0.7, 0.6)], sentence_labels=f"{data}/need.csv", draws=50)
    assert {(r.split, r.correct, r.false_pass) for r in scores.collect()} == {("dev", 1.0, 0.0), ("test", 1.0, 0.0)}
    report = [r.value for r in spark.read.text(f"{out}/final_report").collect()]
    assert any(x.startswith("| 0.70 | 0.60 | 0.000 (0.000 to 0.000) | 0.000 | 100.0% | 0.0%") for x in report) and any("border: 0" in x for x in report)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        commands.final(spark, f"{data}/labels.csv", data, out, [(0.7, 0.6)], draws=50)
    with pytest.raises(ValueError, match="at most"):
        commands.final(spark, f"{data}/labels.csv", data, out, [(k / 10, 0.6) for k in range(5)], draws=50)


def test_label_commands(spark, tmp_path):
    lab_files(tmp_path)
    (tmp_path / "questions.csv").write_text("id,group,expression_type,question,writer\n,ans,normal,First one,me\n,OFF,CASUAL,Second,me\n,OFF,CASUAL, first ONE ,me\n")
    merged = commands.merge_questions(spark, [str(tmp_path / "questions.csv")], str(tmp_path / "m"))
    assert [(r.id, r.group) for r in merged.orderBy("id").collect()] == [("Q0001", "ANS"), ("Q0002", "OFF")]
    q = files.read_text_csv(spark, str(tmp_path / "labels.csv")).select("id", F.lit("ANS").alias("group"), "expression_type", "question")
    files.write_csv(q, str(tmp_path / "q"))
    sheet = commands.label_sheet(spark, str(tmp_path / "q"), str(tmp_path), str(tmp_path / "sheet")).collect()
    assert len(sheet) == 60 and all(r.candidate_4 and r.candidate_5 == "" and r.label == "" for r in sheet)
    assert 0 < sum(r.candidate_1.startswith("[F1]") for r in sheet) < 40 and any("| an answer" in r.candidate_1 for r in sheet)
    said = []
    assert commands.sentence_sheet(spark, str(tmp_path / "labels.csv"), str(tmp_path), str(tmp_path / "s"), said.append).count() == 120 and not said
    (tmp_path / "a.csv").write_text("id,question,intended_group,expression_type,label,gold_faq_ids\n1,q,ANS,NORMAL,answer,F1\n2,q,ANS,NORMAL,BORDER,\n")
    (tmp_path / "b.csv").write_text("id,question,intended_group,expression_type,label,gold_faq_ids\n1,q,ANS,NORMAL,ANSWER,F1;F2\n2,q,ANS,NORMAL,ANSWER,F1\n")
    both = commands.merge_labels(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), str(tmp_path / "ab"), said.append)
    assert sorted((r.id, r.status) for r in both.collect()) == [("1", "AGREED"), ("2", "CONFLICT")] and said


def test_benchmark_cluster_intents(spark, workbook, tmp_path):
    out = commands.model_benchmark(spark, workbook, str(tmp_path / "b"), [commands.ModelSpec("m")], "FAQ", {"Easy": "E", "Hard": "H"})
    assert {r.category: r.top1 for r in out.collect()} == {"전체": 1.0, "E": 1.0, "H": 1.0}
    path = str(tmp_path / "c.xlsx")
    make_xlsx(path, {"S": [["id", "q", "expected"], *[[f"I{k}", ["data gift to a friend", "record a phone call"][k % 2], ["gift", "call / more"][k % 2]] for k in range(10)], ["I99", "unrelated thing", "노이즈"]]})
    r = commands.cluster_questions(spark, path, "S", str(tmp_path / "log"), [3, 4]).collect()
    assert sorted(x.min_cluster_size for x in r) == [3, 4] and all(x.n_clusters == 2 and x.ari > 0.9 for x in r)
    (tmp_path / "corpus.csv").write_text("q,intent\nreset my password,FAQ\nwhere is the shop,MAP\n")
    (tmp_path / "cases.csv").write_text("q,intent\nreset password,f\nwhere is shop,m\nzzz,무관\n")
    rec = commands.intent_analysis(spark, str(tmp_path / "corpus.csv"), str(tmp_path / "cases.csv"), str(tmp_path / "i"), {"FAQ": "f", "MAP": "m"}, sweep="0.5", rerank=True)
    assert {r.intent: r.rate for r in rec.collect()} == {"f": 1.0, "m": 1.0, None: 1.0}
    assert commands.pair_similarity(spark, "a b", "a b") == pytest.approx(1.0)


def test_parser():
    a = commands.parser().parse_args(["dev", "--labels", "l", "--data", "d", "--out", "o", "--t1", "0.5:0.6:0.05"])
    assert a.t1 == (0.5, 0.6, 0.05) and a.prior == 0.75 and a.draws == 1000


def test_nothing_else_imports_the_training_data_package():
    for path in [*ROOT.glob("gleaner/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("gleaner.llm", "corpus_pipeline")) for n in names), path


def test_encoded_texts_and_stages(spark):
    from gleaner.functions.models import ModelSpec, encode_column
    from gleaner.operators import retrieve

    corpus = spark.createDataFrame([(1, "reset my password"), (2, "reset the router"), (3, "pay a bill"), (4, "")], "cid int, text string")
    q = spark.createDataFrame([(7, "password reset"), (8, "")], "qid int, text string")
    enc = lambda df, key: df.select(key, "text", encode_column(F.col("text"), ModelSpec("hashed"), late=True).alias("enc"))
    c, a = enc(corpus, "cid").persist(), enc(q, "qid").persist()
    one = a.where("qid = 7").first().enc
    assert one.sparse == {"password": 0.5, "reset": 0.5} and len(one.tokens) == 2 and len(one.dense) == 256
    assert a.where("qid = 8").first().enc.sparse == {}
    for more in ({"alpha": None}, {}, {"late": True}, {"scorer": lambda x, y: F.when(y.contains("password"), 1.0).otherwise(0.0)}):
        hits = retrieve.search(a, c, k=2, **more).where("qid = 7").orderBy("rank").collect()
        assert [h["rank"] for h in hits] == [1, 2] and hits[0].cid == 1
    mixed = retrieve.search(a, c, k=1).where("qid = 7").first().score
    dense = retrieve.search(a, c, k=1, alpha=None).where("qid = 7").first().score
    assert mixed == pytest.approx(0.6 * dense + 0.4 * (2 * 0.5 / 3), abs=1e-5)
    with pytest.raises(ValueError, match="exclude"):
        retrieve.search(a, c, scorer=lambda x, y: F.lit(0.0), late=True)


def test_http_embedder_and_registry():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from gleaner.functions.models import REGISTRY, ModelSpec, build_embedder

    class Service(BaseHTTPRequestHandler):
        def _say(self, what):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(what).encode())

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self._say({"embeddings": [[float(len(t)), 1.0] for t in body["input"]]})

        def do_GET(self):
            self._say({"models": [{"name": "m", "size": 42}]})

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    model = build_embedder(ModelSpec("m", "http", options={"url": f"{root}/embed", "loaded_url": f"{root}/ps", "batch": 2}))
    assert model.embed_batch(["a", "bb", "ccc"]) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0]] and model.memory_usage() == "42"
    server.shutdown()
    server.server_close()
    with pytest.raises(OSError):
        model.embed_batch(["a"])
    assert len(REGISTRY) == 5 and {s.style for s in REGISTRY} == {"none", "prefix", "prompt_name", "method"}


def test_runs_have_numbers_and_details(spark, workbook, tmp_path):
    b = str(tmp_path / "b")
    for _ in range(2):
        got = commands.model_benchmark(spark, workbook, b, [commands.ModelSpec("m"), commands.ModelSpec("gone", "sentence_transformers", options={"hf_id": "x"})], "FAQ", {"Easy": "E", "Hard": "H"}).collect()
    assert {r.run for r in spark.read.parquet(b).collect()} == {1, 2} and {r.model for r in got} == {"m"}
    whole = [r for r in got if r.category == "전체"]
    assert whole[0].avg_latency > 0 and all(r.avg_latency is None for r in got if r.category != "전체")
    detail = spark.read.parquet(f"{b}_detail").collect()
    assert sorted((r.run, r.qid, r.gt_rank) for r in detail) == [(n, t, 1) for n in (1, 2) for t in ("T1", "T2", "T9")]


def test_rerankers(spark, workbook, tmp_path):
    from gleaner.functions.models import SCORERS, ModelSpec

    class Reverse:
        """Prefers texts that don't share words with the query."""

        def __init__(self, spec):
            pass

        def predict(self, pairs):
            return [-float(len(set(q.split()) & set(t.split()))) for q, t in pairs]

    SCORERS["reverse"] = Reverse
    try:
        out = str(tmp_path / "r")
        got = commands.rerankers(spark, workbook, out, [(2, 2), (2, 1)], "FAQ", {"Easy": "E", "Hard": "H"}, scorers=[ModelSpec("lexical", "lexical"), ModelSpec("reverse", "reverse"), ModelSpec("none", "nothing")]).collect()
    finally:
        del SCORERS["reverse"]
    at = {(r.reranker, r.final_k, r.category): r for r in got}
    assert {r.reranker for r in got} == {"lexical", "reverse"}
    same, turned, cut = at["lexical", 2, "전체"], at["reverse", 2, "전체"], at["reverse", 1, "전체"]
    assert (same.n, same.baseline_top1, same.reranked_top1, same.n_unchanged) == (3, 1.0, 1.0, 3)
    assert turned.reranked_top1 < 1 and turned.n_worsened > 0 and cut.n_worsened == turned.n_worsened
    assert turned.avg_rerank_latency_sec >= 0 and turned.avg_embed_latency_sec >= 0 and at["reverse", 2, "E"].avg_rerank_latency_sec is None
    lines = [r.value for r in spark.read.text(f"{out}_log").collect()]
    assert len(lines) == 12 and all(x.startswith("run 1 | ") and " -> " in x for x in lines)


def test_collect_scores(spark, tmp_path):
    from gleaner.functions.models import EMBEDDERS, HashedEmbedder, ModelSpec

    class Picky(HashedEmbedder):
        def embed_batch(self, texts, mode="passage"):
            if any("fail" in t for t in texts):
                raise RuntimeError("refused")
            return super().embed_batch(texts, mode)

    rows = [(1, 10, "FAQ", "Reset?", "reset my password", "Open settings. Press reset password!", 3, None), (1, 11, "FAQ", "Reset?", "forgot password", "Open settings. Press reset password!", 3, None), (2, 12, "FAQ", "Pay?", "pay the bill", "Use a card.", 1, None), (3, 13, "FAQ", "Old?", "reset my password", "Gone.", 9, "2020-01-01")]
    faqs = spark.createDataFrame(rows, "faq_id long, variant_id long, intent string, question string, variant_question string, answer string, version long, deleted_at string")
    (tmp_path / "q.csv").write_text("id,question\nQ1,reset my password\nQ2,please fail\n,no id\nQ3,pay the bill\n")
    said, out = [], str(tmp_path / "out")
    EMBEDDERS["picky"] = Picky
    try:
        commands.collect_scores(spark, str(tmp_path / "q.csv"), faqs, out, ModelSpec("picky", "picky"), k=2, alive="deleted_at is null", warn=said.append)
    finally:
        del EMBEDDERS["picky"]
    read = lambda n: files.read_text_csv(spark, f"{out}/{n}.csv")
    got = [(r.qid, r["rank"], r.faq_id, r.variant_id) for r in read("candidates").orderBy("qid", "rank").collect()]
    assert got[0] == ("Q1", "1", "1", "10") and ("Q3", "1", "2", "12") in got and len(got) == 4
    assert read("candidates").where("qid = 'Q1' and rank = 1").first().similarity == "1.0"
    sent = {(r.qid, r.faq_id, r.sentence_idx): r.sentence for r in read("sentences").collect()}
    assert sent["Q1", "1", "0"] == "Open settings." and sent["Q1", "1", "1"] == "Press reset password!" and len(sent) == 6
    assert {r.faq_id for r in read("faq_catalog").collect()} == {"1", "2"}
    assert [(r.qid, r.error) for r in read("errors").collect()] == [("Q2", "RuntimeError: refused")] and said == ["1 questions failed"]
    meta = [r.value for r in spark.read.text(f"{out}/meta").collect()]
    assert "n=3, ok=2, failed=1" in meta and "before: n=3, max_id=2, sum_version=7" in meta and meta[-1] == "changed=no"
    assert spark.table("faq_vectors").count() == 3


def test_every_command_parses():
    p = commands.parser().parse_args
    book = ["--xlsx", "x", "--query-sheet", "S=c", "--output", "o"]
    assert p(["rerank", *book]).top_k == [3, 5, 10, 15, 20] and p(["rerankbuffer", *book]).buffer == [0, 5, 10, 15]
    assert p(["benchmark", *book, "--models", "a, b"]).models == ["a", "b"]
    assert p(["cluster", "--xlsx", "x", "--sheet", "s", "--output", "o"]).min_cluster_size == [2, 3, 4, 5, 6]
    a = p(["intents", "--groups", "g.json"])
    assert (a.k, a.prefilter_n, a.hybrid_alpha, a.thresholds) == (3, 50, 0.6, "0.30:0.90:0.02")
    assert p(["collect", "--questions", "q", "--faqs", "f", "--out", "o"]).k == 10
