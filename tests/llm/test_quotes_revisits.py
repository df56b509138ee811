import random
import re
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, quotes, revisits

MESSAGES = [
    (1, 0, "u", "Hello there\nSecond line"), (1, 1, "a", "> hello   there\n> Second line\nMy reply"),
    (1, 2, "u", ">> Hello there\n> My reply\nok then"), (2, 0, "u", "> Second line\nfoo"), (3, 0, "u", None),
    (None, 5, "u", "x > y\n> zzz"), (1, 1, "a", "> hello   there\n> Second line\nMy reply"), (4, 0, None, ""),
    (5, 0, "u", "> not written anywhere\nbar"), (5, 1, "u", "para one\nstill\n\npara two"), (6, 0, "u", "> para one\n> still\n\nyes"),
]


def test_quotes_are_linked_and_removed(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1)).withColumn("path", F.lit("x"))
    rows = {(r.conv_id, r.turn): r for r in quotes.link(df, follow_turns=False).collect()}
    assert len(rows) == len(MESSAGES) - 1
    parent = {k: (r.parent_conv_id, r.parent_turn) for k, r in rows.items() if r.parent_turn is not None}
    assert parent == {(1, 1): (1, 0), (1, 2): (1, 1), (2, 0): (1, 0), (6, 0): (5, 1)}
    assert {k: r.clean_text for k, r in rows.items() if r.n_quotes} == {(1, 1): "My reply", (1, 2): "ok then", (2, 0): "foo", (None, 5): "x > y", (5, 0): "bar", (6, 0): "\nyes"}
    assert rows[1, 2].n_quotes == rows[1, 2].n_linked == 2 and rows[5, 0].n_linked == 0
    thread = sorted((r.position, k) for k, r in rows.items() if (r.thread_conv_id, r.thread_turn) == (1, 0))
    assert thread == [(1, (1, 0)), (2, (1, 1)), (3, (1, 2)), (4, (2, 0))]
    assert [rows[k].depth for _, k in thread] == [0, 1, 2, 1]


def brute_links(messages):
    """Parent, thread, position, depth, quotes and links of each (conversation, turn)."""
    def normal(t):
        return re.sub(r"\s+", " ", t.lower()).strip(" ")

    units, asked, order = {}, {}, sorted((c, t) for c, t, _ in messages)
    for c, t, text in messages:
        lines = []
        for x in re.split("\r?\n", text):
            mark = re.match(r"(?:[ \t]*>)+[ \t]?", x)
            lines.append((mark[0].count(">") if mark else 0, x[mark.end() :] if mark else x))
        own = "\n".join(b for n, b in lines if not n)
        units[c, t] = {normal(u) for u in [own, *re.split(r"\n[ \t]*\n", own), *own.split("\n")]} - {""}
        asked[c, t], i = [], 0
        while i < len(lines):
            j = i
            while j < len(lines) and lines[j][0] == lines[i][0]:
                j += 1
            body = [b for _, b in lines[i:j]]
            if lines[i][0] and "\n".join(body).strip(" "):
                whole = normal("\n".join(body))
                asked[c, t].append((i, lines[i][0], [(0, whole), *((1, u) for u in {normal(b) for b in body} - {"", whole})]))
            i = j
    out, kids = {}, {}
    for at in order:
        best, linked = [], set()
        for pos, level, us in asked[at]:
            for part, u in us:
                here = [x for x in order if x[0] == at[0] and u in units[x]][:1]
                first = [x for x in order if u in units[x]][:1]
                origin, elsewhere = (here[0], False) if here and here[0] < at else (first[0], True) if first and first[0] < at else (None, True)
                if origin:
                    best.append((level, part, elsewhere, -len(u), pos, origin))
                    linked.add(pos)
        earlier = [x for x in order if x[0] == at[0] and x < at]
        parent = min(best)[-1] if best else earlier[-1] if earlier else None
        out[at] = [parent, len(asked[at]), len(linked)]
        kids.setdefault(parent, []).append(at)
    for root in kids[None]:
        todo, n = [(root, 0)], 0
        while todo:
            at, depth = todo.pop()
            n += 1
            out[at] += [root, n, depth]
            todo += [(k, depth + 1) for k in reversed(kids.get(at, []))]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_threads_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    lines = [f"{rnd.choice('Hi Hello Well Thanks'.split())} {rnd.choice('abcdefgh')}{rnd.choice(['', '  again', ' B'])}" for _ in range(25)]
    messages = []
    for c in range(7):
        for t in range(rnd.randint(1, 9)):
            text = []
            for _ in range(rnd.randint(0, 6)):
                if messages and rnd.random() < 0.5:
                    mark = rnd.choice(["> ", ">", ">> ", "> > ", " >"])
                    said = rnd.choice(messages)[2].split("\n")
                    i = rnd.randrange(len(said))
                    text += [mark + x for x in said[i : i + rnd.randint(1, 4)]]
                else:
                    text.append(rnd.choice([*lines, "", " \t"]))
            messages.append((c, t, rnd.choice(["\n", "\r\n"]).join(text).replace("\r", "") if rnd.random() < 0.8 else "\r\n".join(text)))
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in messages], "conv_id long, turn long, role string, text string").repartition(3)
    got = {(r.conv_id, r.turn): [None if r.parent_turn is None else (r.parent_conv_id, r.parent_turn), r.n_quotes, r.n_linked, (r.thread_conv_id, r.thread_turn), r.position, r.depth] for r in quotes.link(df).collect()}
    assert got == brute_links(messages)


def test_a_very_long_message(spark):
    """200,000 lines whose level changes at every other one."""
    n = 200_000
    text = "\n".join(f"{'> ' * (i % 4 // 2)}line {i}" for i in range(n))
    df = spark.createDataFrame([(1, 0, "u", text), (1, 1, "a", "> line 0\nyes")], "conv_id long, turn long, role string, text string")
    began = time.time()
    got = {r.turn: r for r in quotes.link(df).collect()}
    assert time.time() - began < 60
    assert got[0].n_quotes == n // 4 and got[0].n_linked == 0 and got[1].parent_turn == 0 and got[1].n_linked == 1
    assert got[0].clean_text.count("\n") == n // 2 - 1


def test_messages_without_quotes_follow_their_turns(spark, sf_dir):
    rows = queries.op2_quotation_linking(spark, sf_dir).collect()
    known = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    assert len(rows) == len(known)
    order = {}
    for r in sorted(known, key=lambda r: (r.conv_id, r.turn)):
        order.setdefault(r.conv_id, []).append(r.turn)
    for r in rows:
        turns = order[r.conv_id]
        i = turns.index(r.turn)
        assert (r.parent_turn, r.position, r.depth) == (turns[i - 1] if i else None, i + 1, i)


def test_a_chain_of_quotes_is_one_thread(spark):
    rows = [(i, 0, "u", f"> message {i - 1}\nmessage {i}") for i in range(40)]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id, r.position, r.depth) for r in got) == [(i, i + 1, i) for i in range(40)]


def test_a_passage_that_all_quote_is_one_thread(spark):
    """A thread of 500 messages over several partitions is numbered without gaps."""
    rows = [(0, 0, "u", "the origin"), *((i, 0, "u", f"> the origin\nreply {i}") for i in range(1, 500))]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(9)).collect()
    assert sorted((r.position, r.conv_id) for r in got) == [(i + 1, i) for i in range(500)]


def test_common_greetings_do_not_tie_conversations_together(spark):
    """The whole passage counts before its lines, and the own conversation before others."""
    rows = [(0, 0, "u", "Hi,\nsomething else\nThanks")]
    for i in range(1, 30):
        rows += [(i, 0, "u", f"Hi,\nmy question {i}"), (i, 1, "a", f"> Hi,\n> my question {i}\nanswer {i}"), (i, 2, "u", "> Hi,\nthis only greets"), (i, 3, "a", f"> Hi,\n> answer {i}\nmore")]
    rows += [(50, 0, "u", "> Thanks\nmine"), (51, 0, "u", "> something else\n> unknown\n\nmine too")]
    got = {(r.conv_id, r.turn): (r.parent_conv_id, r.parent_turn) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), follow_turns=False).collect()}
    for i in range(1, 30):
        assert [got[i, t] for t in range(4)] == [(None, None), (i, 0), (i, 0), (i, 1)]
    assert got[50, 0] == got[51, 0] == (0, 0)


def test_numbers_within_groups(spark):
    from millrace.llm.common import numbered

    df = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(3000)], "g long, x long").repartition(11)
    got = {r.x: r.n for r in numbered(df, "g", ["x"], "n").collect()}
    hot = [x for x in range(3000) if x % 3]
    assert got == {x: 1 for x in range(3000) if not x % 3} | {x: i + 1 for i, x in enumerate(hot)}


def test_empty_messages(spark):
    assert quotes.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_canonical_urls(spark):
    same = ["http://www.Ex.com/a/?b=2&a=1", "https://ex.com:443/a?a=1&utm_source=f&b=2#top", "m.ex.com/a/?ref=x&a=1&b=2"]
    rows = spark.createDataFrame([(u,) for u in [*same, "", None, "http://ex.com", "http://ex.com/", "http://blog.ex.com/"]], "u string")
    got = [r.k for r in rows.select(revisits.canonical(F.col("u")).alias("k")).collect()]
    assert got == ["ex.com/a?a=1&b=2"] * 3 + [None, None, "ex.com", "ex.com", "blog.ex.com"]


RECORDS = [
    (1, "http://a.com/x", 10, "response", "t1", None, {"content-type": "html", "date": "d10", "etag": "t1"}),
    (2, "http://www.a.com/x/", 20, "revisit", "t1", None, {"date": "d20", "content-type": "none"}),
    (3, "http://a.com/x", 20, "response", "t2", None, {"content-type": "html2"}),
    (4, "http://a.com/x", 30, "revisit", "t1", None, {"date": "d30"}), (5, "http://a.com/x", 31, "revisit", "t2", None, None),
    (6, "http://b.com", 5, "revisit", "t", None, {}), (7, "http://b.com", 9, "response", None, "mon", {"vary": "x", "age": "1"}),
    (8, "http://b.com", 10_000, "revisit", None, "mon", {"vary": "y"}), (9, "http://b.com", 10_001, "revisit", "only", None, {}),
    (10, None, 3, "revisit", "t", None, {}), (11, "http://b.com", None, "revisit", "t", None, {}),
    (8, "http://b.com", 10_000, "revisit", None, "mon", {"vary": "y"}),
]


def brute(records):
    out = []
    for rid, url, ts, kind, tag, date, headers in records:
        if kind != "revisit":
            continue
        key = None if not url else url.split("//")[-1].removeprefix("www.").rstrip("/")
        seen = [r for r in records if r[3] == "response" and r[2] is not None and ts is not None and r[2] < ts and r[1] and key and r[1].split("//")[-1].removeprefix("www.").rstrip("/") == key]
        r = max(seen, key=lambda r: (r[2], r[0]), default=None)
        if r is None:
            out.append((rid, None, "no_response", None))
            continue
        agree = tag == r[4] if tag and r[4] else date == r[5] if date and r[5] else None
        status = {True: "resolved", False: "validator_mismatch", None: "no_validator"}[agree]
        sent = {k: v for k, v in (headers or {}).items() if k in revisits.PERMITTED}
        out.append((rid, r[0] if agree else None, status, {**r[6], **sent} if agree else None))
    return out


def test_revisits_against_brute_force(spark):
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>"
    df = spark.createDataFrame(RECORDS, schema).withColumn("slice", F.lit(3)).withColumn("u", F.lit("z"))
    for ranges in (None, 1, 7, 64):
        got = [(r.record_id, r.source_id, r.status, r.headers) for r in revisits.resolve(df, ranges=ranges).collect()]
        assert sorted(got, key=str) == sorted(brute(RECORDS), key=str)
    assert revisits.resolve(df.limit(0)).count() == 0


def test_a_hot_url_with_bursts_of_one_second(spark):
    """Many records of one URL and one time, over many ranges, very long validators and ids beyond 2**53."""
    rnd = random.Random(5)
    big = (1 << 63) - 2000
    rows = [(big + i, "http://hot.com/", rnd.choice((7, 7, 7, rnd.randint(0, 40))), rnd.choice(("response", "revisit")), rnd.choice(("a", "b" * 5000, None)), rnd.choice(("mon", None)), {"etag": "x", "date": str(i)}) for i in range(600)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>")
    got = [(r.record_id, r.source_id, r.status, r.headers) for r in revisits.resolve(df, ranges=13).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_query_against_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = c.sql(queries.ORACLE_SQL["op4_revisit_resolution"])
    df = queries.op4_revisit_resolution(spark, sf_dir)
    rows = [tuple(r[x] for x in want.columns) for r in df.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want.fetchall()))
    status = Counter(r[want.columns.index("status")] for r in rows)
    assert set(status) == {"resolved", "validator_mismatch", "no_validator", "no_response"}
    # a join that ignores time gives other rows
    timeless = c.sql(queries.ORACLE_SQL["op4_revisit_resolution"].replace("and r.ts > l.ts", "and r.ts > l.ts - 1000000")).fetchall()
    assert sorted(map(repr, rows)) != sorted(map(repr, timeless))
