"""The chat client against a server of its own, calls in flight, coercion, and scores that outlive a failure."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import types as T

from brookloom.operators import client, scoring

SCHEMA = T.StructType([T.StructField("clarity", T.LongType()), T.StructField("comment", T.StringType())])


class Service:
    """Streams answers in pieces; prompts say how: 'slow', 'busy' (429 once), 'broken' (500 always), 'refused' (400), 'chatter' (no JSON once), 'silent'."""

    def __init__(self):
        self.lock, self.now, self.most, self.seen = threading.Lock(), 0, 0, []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                prompt = body["messages"][0]["content"]
                with outer.lock:
                    outer.now += 1
                    outer.most = max(outer.most, outer.now)
                    before = sum(p == prompt for p, _ in outer.seen)
                    outer.seen.append((prompt, body))
                try:
                    time.sleep(0.3 if "slow" in prompt else 0.02)
                    status = 500 if "broken" in prompt else 400 if "refused" in prompt else 429 if "busy" in prompt and not before else 200
                    self.send_response(status)
                    self.end_headers()
                    if status != 200:
                        self.wfile.write(b"no")
                        return
                    if "silent" in prompt:
                        time.sleep(1.5)
                    text = "only talk" if "chatter" in prompt and not before else 'Sure: {"clarity": %d, "comment": "é%s"} bye' % (len(prompt), prompt)
                    for k in range(0, len(text), 7):
                        piece = json.dumps({"message": {"content": text[k : k + 7]}} if k % 2 else {"response": text[k : k + 7]})
                        self.wfile.write((("data: " if k % 3 else "") + piece + "\n").encode())
                    self.wfile.write(b"\nevent: end\n{broken\n")
                finally:
                    with outer.lock:
                        outer.now -= 1

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/"


@pytest.fixture
def services():
    both = [Service(), Service()]
    yield both
    for s in both:
        s.server.shutdown()


def test_overlap_order_turns_and_retries(services):
    clients = [client.ChatClient(s.url, "m", options={"num_ctx": 9}) for s in services]
    prompts = [(k, w) for k, w in enumerate(["slow a", "b", "busy c", "d", "broken e", "refused f", "chatter g", *(f"slow {k}" for k in range(9))])]
    start = time.perf_counter()
    got = list(client.asked(iter(prompts), clients, in_flight=6, tries=3, wait=0.01))
    took = time.perf_counter() - start
    assert [k for k, _ in got] == list(range(len(prompts)))  # in order, though the first is slow
    assert took < 0.3 * 10 * 0.6  # ten slow calls overlap
    assert all(s.most > 1 for s in services) and sum(s.most for s in services) <= 2 * 6
    by = dict(zip((w for _, w in prompts), (a for _, a in got), strict=True))
    assert by["b"].answer == {"clarity": 1, "comment": "éb"} and by["b"].tries == 1
    assert by["busy c"].tries == 2 and by["chatter g"].tries == 2
    assert (by["broken e"].tries, by["refused f"].tries) == (3, 1)
    assert by["broken e"].answer is None and "status 500" in by["broken e"].error and "status 400" in by["refused f"].error
    assert all((k % 2 == 0) == any(p == w for p, _ in services[0].seen) for k, w in prompts)  # endpoints take turns
    assert services[0].seen[0][1]["options"] == {"num_ctx": 9} and services[0].seen[0][1]["stream"] is True


def test_timeouts_and_lost_servers(services):
    (_, late), = client.asked([(1, "silent")], [client.ChatClient(services[0].url, "m", timeout=0.2)], tries=2, wait=0.0)
    assert late.answer is None and late.tries == 2 and "imed out" in late.error
    (_, gone), = client.asked([(1, "x")], [client.ChatClient("http://127.0.0.1:9", "m", connect_timeout=0.5)], tries=2, wait=0.0)
    assert gone.answer is None and gone.tries == 2
    (_, cut), = client.asked([(1, "x")], [lambda p: time.sleep(1) or {}], tries=1, timeout=0.1)
    assert cut.error.startswith("TimeoutError")


def test_in_flight_is_bounded(services):
    list(client.asked([(k, f"slow {k}") for k in range(8)], [client.ChatClient(services[0].url, "m")], in_flight=3))
    assert services[0].most == 3


def test_lines_of_a_stream():
    lines = [b'{"message": {"content": "a"}}', b"data: {\"response\": \"b\"}", b"", b"data:", b"[1]", b"{bad", b'{"message": null, "response": "c"}', b'{"message": "text"}', b"\xff{", b'{"done": true}']
    assert client.streamed_text(lines) == "abc"


def test_answers_are_coerced(spark):
    said = {"a": {"clarity": 2.7, "comment": "x"}, "b": {"clarity": "n/a", "comment": None}, "c": {"clarity": "3", "comment": ["y"]}, "d": [1], "e": None, "f": {"clarity": True}, "g": {"clarity": float("inf")}}
    rows = spark.createDataFrame([(k, k) for k in said] + [("n", None)], "k string, p string")
    got = {r.k: r for r in scoring.answers(rows, "k", "p", lambda p: said.get(p), SCHEMA, tries=1).collect()}
    assert {k: (r.clarity, r.comment) for k, r in got.items()} == {"a": (2, "x"), "b": (None, None), "c": (3, '["y"]'), "d": (None, None), "e": (None, None), "f": (1, None), "g": (None, None), "n": (None, None)}
    assert {k for k, r in got.items() if r.error} == {"d", "e", "n"}
    assert sorted(r.k for r in scoring.scored(rows, "k", "p", lambda p: said.get(p), SCHEMA, tries=1).collect()) == ["a", "b", "c", "f", "g"]


def test_a_failure_pays_for_one_batch(spark, tmp_path):
    """The client's process dies in the middle; the next call asks only what wasn't committed."""
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()

    def count():
        return [p.name.split("-")[0] for p in calls.iterdir()]

    def ask(prompt):
        (calls / f"{prompt}-{__import__('uuid').uuid4().hex}").write_text("")
        if len(count()) > 25 and not (tmp_path / "mended").exists():
            raise SystemExit("the executor is lost")
        return {"clarity": int(prompt) % 3, "comment": "c"}

    rows = spark.range(40).selectExpr("id", "cast(id as string) as p").coalesce(1)
    with pytest.raises(Exception):  # noqa: B017, PT011  however Spark words it
        scoring.stored_scores(rows, "id", "p", ask, SCHEMA, store, per_batch=10, in_flight=1, tries=1)
    paid, done = count(), {r.id for r in scoring.call_log(spark, store).collect()}
    assert len(paid) - len(done) <= 15 and len(done) >= 11  # 26 calls were made; what isn't committed is of one batch
    (tmp_path / "mended").write_text("")
    got = scoring.stored_scores(rows, "id", "p", ask, SCHEMA, store, per_batch=10, in_flight=4, tries=1)
    assert sorted((r.id, r.clarity) for r in got.collect()) == [(k, k % 3) for k in range(40)]
    after = count()
    assert all(after.count(str(k)) == 1 for k in done) and len(after) == len(paid) + 40 - len(done)
    again = scoring.stored_scores(rows, "id", "p", ask, SCHEMA, store, per_batch=10)
    assert again.count() == 40 and len(count()) == len(after)


def test_failed_calls_are_logged_and_asked_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, p string")
    flag, store = tmp_path / "up", str(tmp_path / "s")

    def ask(prompt):
        if prompt == "b" and not flag.exists():
            raise client.ServiceError(503)
        return {"clarity": 1, "comment": prompt}

    assert [r.id for r in scoring.stored_scores(rows, "id", "p", ask, SCHEMA, store, tries=2, wait=0.0).collect()] == [1]
    assert {(r.id, r.tries, bool(r.error)) for r in scoring.call_log(spark, store).collect()} == {(1, 1, False), (2, 2, True)}
    flag.write_text("")
    assert sorted(r.id for r in scoring.stored_scores(rows, "id", "p", ask, SCHEMA, store).collect()) == [1, 2]
