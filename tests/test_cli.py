import csv
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from demosift import cli
from demosift.operators import model_calls
from demosift.sources import tables


class Server(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        bad = self.headers.get("Authorization") == "Bearer bad"
        answer = json.dumps({"choices": [{"message": {"content": f" {body['model']} "}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 1, "completion_tokens": 1, "total_tokens": 2}}).encode()
        self.send_response(500 if bad else 200)
        self.send_header("Content-Length", str(len(answer)))
        self.end_headers()
        self.wfile.write(answer)

    def log_message(self, *args):
        pass


@pytest.fixture()
def url():
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def test_http_pool(url):
    pool = model_calls.http_pool(url, ["bad", "good"])
    output, usage, info = model_calls.call(pool, {"model": "m", "max_tokens": 5, "extra_body": {"enable_thinking": False}}, max_retries=0)
    assert (output, usage["total_tokens"], info["api_key_index"], info["finish_reason"]) == ("m", 2, 2, "stop")


def test_run_and_evaluate(spark, tmp_path, url):
    for split in ("train", "test"):
        with open(tmp_path / f"{split}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows([("source_text", "target_text", "source_lang", "target_lang", "type"), *[(f"s{i} x", f"t{i}", "chg", "en", "phrase") for i in range(6)]])
    out = tmp_path / "out"
    cli.main(["run", "--data_dir", str(tmp_path), "--output_dir", str(out), "--base_url", url, "--model", "m", "--strategies", "similarity", "zero", "--k_list", "2", "--max_examples", "3", "--run_name", "r", "--retry_delay", "0"])
    found = spark.read.parquet(str(out / "predictions_r"))
    assert found.count() == 6 and {r.prediction for r in found.collect()} == {"m"}
    requests = tables.request_previews(spark.read.json(str(out / "requests_r")))
    assert all(r.prompt.startswith("Task: Translate") for r in requests.collect())
    assert len(spark.read.json(str(out / "retrieved_examples_r")).where("strategy = 'similarity'").first().retrieved_examples) == 2
    manifest = json.loads((out / "manifest_r.json").read_text())
    assert manifest["data"]["test_rows"] == 3 and manifest["data"]["train_type_counts"] == {"phrase": 6}
    found.select("prediction", "reference", "target_lang", "strategy", "k", "model").toPandas().to_csv(tmp_path / "p.csv", index=False)
    cli.main(["evaluate", "--predictions", str(tmp_path / "p.csv"), "--summary", str(tmp_path / "s.csv")])
    lines = (tmp_path / "s.csv").read_text(encoding="utf-8-sig").splitlines()
    assert lines[0].startswith("model,target_lang,strategy,k,BLEU,chrF,BERTScore,format_error_rate") and len(lines) == 3
