"""Url filter, conversation repair and Merkle manifest against brute force, and on odd tables; license headings."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import conversation_repair, merkle, registry, url_filter
from tallyframe.llm.conversation_repair import Repair, damaged, repair_report
from tallyframe.llm.licenses import scan_licenses
from tallyframe.llm.merkle import manifest
from tallyframe.llm.url_filter import Rule, judge_urls
from tests.conftest import SF_SMALL

# -- 11: urls ------------------------------------------------------------------------------------

URLS = "page_id long, url string, host string, path string, template string, n int, node string"


def _urls(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y", "z", 1, "w") for i, u in enumerate(urls)], URLS)


def test_rules_and_parts_of_urls(spark):
    urls = ["http://A.Example.NET/en/x?q", "https://example.net/EN/", "ftp://net", "http://net/", "http://sub.net?x://y/", "http://internet/", "https://b.example.com/de/1#t", "http://example.com/de",
            "http://x.org/fr/1", "x://y://z/a", "no scheme", "", None, "://", "http:///p", "http://ÉX.net/\n/é"]
    got = {r.page_id: r for r in judge_urls(_urls(spark, urls)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        after = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split("[/?#]", after)[0]
        path = re.split("[?#]", after[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text)) if fits else None
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best.text if best else None), u
        assert got[i].verdict == (best.verdict if best else "allow")


def test_templates_generalise_merge_and_reject(spark):
    """Branches like one another are merged, one that differs is not, names with few paths become a wildcard, and a template of blocked labels is rejected."""
    urls = [f"http://a.test/{b}/item-x/{i}" for b in ("one", "two", "three") for i in range(30)]
    urls += [f"http://a.test/bad/{i}.html" for i in range(40)]
    urls += [f"http://b.test/u/{chr(97 + i % 26)}{chr(97 + i // 26)}x/home" for i in range(60)]
    urls += [f"http://b.test/u/{i:08x}/home" for i in range(20)] + ["http://b.test/u/*/home", "http://b.test/u/x+/home"]
    rules = [Rule("block", f"a.test/bad/{i}.html") for i in range(39)]
    got = {u: r for u, r in zip(urls, judge_urls(_urls(spark, urls), rules).orderBy("page_id").collect(), strict=True)}
    assert {got[u].template for u in urls if "/item-x/" in u} == {"/one+/item-x/*"}
    assert {got[u].template for u in urls if "/bad/" in u} == {"/bad/*.html"}
    assert got["http://a.test/bad/39.html"].rule is None and got["http://a.test/bad/39.html"].verdict == "block"
    assert {got[u].verdict for u in urls if "/item-x/" in u} == {"allow"}
    assert {got[u].template for u in urls if "b.test" in u} == {"/u/*/home"}


def test_urls_equal_sql_and_odd_tables(spark):
    rnd = random.Random(5)
    urls = [f"http{rnd.choice(['', 's'])}://{rnd.choice(['a', 'b.a', 'c'])}.{rnd.choice(['net', 'example.com', 'org'])}/"
            + "/".join(rnd.choice(["en", "de", "fr", "7", "12.html", "x" * rnd.randint(1, 3), "", "0a1b2c3d"]) for _ in range(rnd.randint(0, 4))) + rnd.choice(["", "?q=1", "#t"]) for _ in range(1500)]
    urls += urls[:300] + ["http://long.org/" + "a/" * 20000, None, ""] * 2
    df = _urls(spark, urls)
    got = judge_urls(df.select("page_id", "url")).toPandas()
    pages = df.toPandas()  # noqa: F841 - read by the SQL
    want = duckdb.sql(registry.ORACLE_URLS).df()
    cols = ["page_id", "host", "path", "rule", "verdict", "template"]
    a, b = (d[cols].astype(object).where(d[cols].notna(), None).sort_values("page_id").values.tolist() for d in (got, want))
    assert a == b
    assert judge_urls(df.limit(0)).collect() == []
    assert judge_urls(df).columns == ["page_id", "url", "n", "node", "host", "path", "rule", "verdict", "template", "purity"]


def test_url_filter_stays_in_catalyst(spark):
    plan = registry.op11_url_filter(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert not re.search("python|arrow|pandas", plan, re.I)


# -- 12: conversations ---------------------------------------------------------------------------

ODD_ROLES = ["user", "assistant", "system", "tool", "", "User", "sys", "upper", None]


def _repair(rows):
    """(role, text) in order -> counts, cost, audit, repaired rows; by plain recursion from the end."""
    rows = [(" " if r is None else r, " " if t is None else t) for r, t in rows]
    faults = []
    for i, (r, t) in enumerate(rows):
        body = re.sub(r"[\x20\x09-\x0D]+", "", t)
        faults.append("blank" if not body else "duplicate" if (r, t) in rows[:i] else "truncated" if body[-1] not in ".!?" else "")
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    done = {"": (0, "", ()), "a": (0, "", ()), "u": (3, "I", ("assistant:",)), "s": (6, "II", ("user:", "assistant:"))}
    for i in range(len(rows) - 1, -1, -1):
        (role, text), new = rows[i], {}
        late = 3 if faults[i] == "truncated" else 0
        for state in step:
            options = [(4 + done[state][0], "D" + done[state][1], done[state][2])]
            if faults[i] not in ("blank", "duplicate"):
                to = step[state]
                options.append((3 + late + done[to][0], "R" + done[to][1], (f"{name[to]}:{text}", *done[to][2])))
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    to = role[:1]
                    options.append((late + done[to][0], "K" + done[to][1], (f"{role}:{text}", *done[to][2])))
            new[state] = min(options)
        for _ in range(3):
            new = {s: min(new[s], (3 + new[step[s]][0], "I" + new[step[s]][1], (f"{name[step[s]]}:", *new[step[s]][2]))) for s in step}
        done = new
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return [sum(f == k for f in faults) for k in ("blank", "duplicate", "truncated")] + [illegal, *done[""]]


def _brute_report(conversations, rows):
    out = {}
    for c in {r[0] for r in conversations}:
        mine = sorted((r[1:] for r in rows if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, " " if r[1] is None else r[1], " " if r[2] is None else r[2]))
        turns = [t for t, _, _ in mine if t is not None]
        *counts, illegal, cost, audit, repaired = _repair([r[1:] for r in mine])
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def _odd_conversations(seed=11):
    rnd, rows = random.Random(seed), []
    for c in [*range(60), None]:
        for t in range(rnd.choice([1, 2, 3, 5, 9])):
            rows.append((c, rnd.choice([t, t, t, t + 2, None]), rnd.choice([*ODD_ROLES, "user", "assistant", "user", "assistant"]), rnd.choice(["Yes.", "No!", "so on", "", " \t", None, "a. ", "é?", "x" * 3 + "."]), 1, "x"))
    for t in range(700):  # a long one, with ties of cost
        rows.append((1000, t, rnd.choice(["user", "assistant", "tool"]), f"{t}{rnd.choice(['.', '', '?'])}", 2, "y"))
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string, block int, conv string"


@pytest.mark.parametrize("log2", [1, 3, 12])
def test_repair_equals_brute_force(spark, monkeypatch, log2):
    """Also where conversations are cut into many pieces."""
    monkeypatch.setattr(conversation_repair, "BLOCK_ROWS_LOG2", log2)
    rows = _odd_conversations()
    df = spark.createDataFrame(rows, CONVERSATIONS)
    got = {r[0]: tuple(r)[1:] for r in repair_report(df, df).collect()}
    assert got == _brute_report(rows, [r[:4] for r in rows])


def test_repaired_rows_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (2, 0, "tool", "")], "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, Repair(df).repaired().collect()))
    assert got == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "", "I"), (1, 2, "user", "Again.", "K"), (1, 3, "assistant", "", "I")] or "".join(r[4] for r in got) == _repair([("user", "Hi."), ("user", "Again.")])[5]
    assert repair_report(df.limit(0), df.limit(0)).collect() == []
    gone = repair_report(df, df.limit(0)).orderBy("conv_id").collect()
    assert [tuple(r) for r in gone] == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (1, 2)]


def test_damage_follows_the_draw(spark):
    rows = [(c, t, r, "A. b! c?") for c in (1, 2, None) for t in (*range(60), None) for r in ("user", "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if d == 4 else " " if r is None else r, "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x)
        want += [row] * (0 if d == 0 else 2 if d == 3 else 1)
    assert sorted(map(str, (tuple(r) for r in damaged(df, "conv_id", "turn", "role", "text").collect()))) == sorted(map(str, want))


def test_query_12_equals_brute_force(spark):
    conversations = registry.read(spark, SF_SMALL, "conversations")
    rows = [tuple(r) for r in damaged(conversations, "conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in registry.op12_conversation_repair(spark, SF_SMALL).collect()}
    assert got == _brute_report([tuple(r) for r in conversations.collect()], rows)


# -- 13: manifest --------------------------------------------------------------------------------

def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(nodes, at):
    """(root, siblings of each level) of the node at a place."""
    siblings = []
    while len(nodes) > 1:
        run = nodes[at // 16 * 16: at // 16 * 16 + 16]
        siblings.append((run[: at % 16], run[at % 16 + 1:]))
        nodes = [_h(*nodes[i: i + 16]) for i in range(0, len(nodes), 16)]
        at //= 16
    return nodes[0], siblings


def _brute_manifest(rows, changed):
    def leaf(row, text):
        return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))

    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    leaves = {s: [leaf(r, r[4]) for r in by_source[s]] for s in order}
    subroots = [_tree(leaves[s], 0)[0] for s in order]
    out = []
    for n, s in enumerate(order):
        for i, r in enumerate(by_source[s]):
            subroot, low = _tree(leaves[s], i)
            root, high = _tree(subroots, n)
            folded = leaf(r, changed(r))
            for left, right in low + high:
                folded = _h(*left, folded, *right)
            out.append((r[0], leaves[s][i], subroot, root, _h(*(x for a, b in low + high for x in a + b)), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sources", [1, 40])
def test_manifest_equals_brute_force(spark, sources):
    rnd = random.Random(sources)
    rows = [(i, None if i % 7 == 0 else f"s{rnd.randrange(sources)}é", None if i % 11 == 0 else "en", None if i % 13 == 0 else i, None if i % 17 == 0 else rnd.choice(["Ab", "", "é" * 5, "X" * 4000]), "t", 1) for i in range(900)]
    rows += rows[:5] + [(3, "s0é", "en", 4, "another", "t", 1), (None, "s0é", None, None, None, "t", 1), (None, None, None, None, None, "t", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, tree string, place int")
    changed = {"text": F.when(F.col("doc_id") % 3 == 0, merkle.lowered(F.col("text"))).otherwise(F.col("text"))}
    got = sorted((tuple(r) for r in manifest(df, changed).collect()), key=str)
    low = {chr(c): chr(c + 32) for c in range(65, 91)}
    assert got == _brute_manifest(rows, lambda r: "".join(low.get(c, c) for c in r[4]) if r[4] is not None and r[0] is not None and r[0] % 3 == 0 else r[4])


def test_manifest_of_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = spark.createDataFrame([(5, "a", "en", 1, "x")], schema)
    row = manifest(one).collect()[0]
    assert row.leaf == row.subroot == row.root == row.folded_root == _h("1:5", "1:a", "2:en", "1:1", "1:x") and row.proof_sha256 == _h() and row.verified
    assert manifest(one.limit(0)).collect() == []


# -- 4: licenses ---------------------------------------------------------------------------------

def test_texts_that_open_with_a_license_equal_sql(spark):
    texts = ["MIT License for all", "Apache License Version 2.0, January 2004", "Mozilla Public License Version 2.0", "GNU General Public License version 3", "CC BY-NC 4.0", "mit", "license mit license", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cols = ["doc_id", "n_words", "n_base", "base_labels", "labels", "score"]
    got = scan_licenses(df).select(*cols).toPandas().round(6)
    documents = df.toPandas()  # noqa: F841 - read by the SQL
    want = duckdb.sql(registry.ORACLE_LICENSES).df()[cols].round(6)
    assert got.sort_values("doc_id").values.tolist() == want.sort_values("doc_id").values.tolist()
    assert got.loc[0, "labels"] == "mit" and got.loc[1, "labels"] == "apache-2"
