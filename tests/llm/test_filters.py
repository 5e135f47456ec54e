import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from veriloom.llm import queries, quality_rules, secret_scans, toxicity, url_filters


def test_url_filter_paths_agree(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7?x", "http://example.com/en/7", "https://x.net/de/8#y", "https://example.net/de/8", "a://org/es/", "http://spam-farm.example.org", "http://notspam-farm.example.org/", "http://com/en/", "http://x.com:80/en/", "http://example.com"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls * 2)] + [(None, "http://b.com/en/", "x")], "page_id bigint, url string, rule string")
    kept = url_filters.url_filter(df, queries.URL_RULES, queries.URL_HOSTS)
    joined = url_filters.url_filter(df, queries.URL_RULES, queries.URL_HOSTS, max_bytes=0)
    a, b = (sorted(map(str, map(tuple, x.collect()))) for x in (kept, joined))
    assert a == b and len(a) == len(urls) * 2 + 1
    by = {r.page_id: r for r in kept.collect()}
    assert (by[3].host, by[3].path, by[3].rule, by[3].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert by[8].verdict == "block" and by[9].verdict == "allow" and by[0].host == "" and by[6].rule == "example.net/de/8"
    assert url_filters.url_filter(df.limit(0), queries.URL_RULES).count() == 0


def test_url_rules_are_the_contracts(spark, tmp_path):
    """The contract's list, written out: each rule's word decides where the rule is the longest that fits."""
    listed = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    want = {rule: action for action, rule in (entry.split() for entry in listed.split(", "))}
    assert {r.rule: r.action for r in queries.URL_RULES} == want
    urls = {"com/en/": "http://a.com/en/1", "example.com/en/7": "http://example.com/en/7", "net/de/": "http://sub.example.net/de/7", "example.net/de/8": "http://example.net/de/81", "org/es/": "http://b.org/es/"}
    spark.createDataFrame(list(enumerate(urls.values())), "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.op1_url_filter(spark, str(tmp_path)).collect()
    assert {r.rule: r.verdict for r in rows} == want and len(rows) == len(urls)


def test_digest_array_confirms_strings(tmp_path):
    entries = [(f"s{i}", i % 2) for i in range(1000)]
    path = tmp_path / "a.bin"
    path.write_bytes(url_filters.DigestArray.build(entries))
    array = url_filters.DigestArray(str(path))
    found = array.find([s for s, _ in entries] + ["absent", ""])
    assert [int(array.actions[i]) for i in found[:-2]] == [a for _, a in entries] and list(found[-2:]) == [-1, -1]
    # A key that is in the array under another string isn't taken.
    array.keys = np.array(array.keys)
    array.blob = np.array(array.blob)
    array.blob[:] = 0
    assert (array.find(["s1", "s2"]) == -1).all()


def stats_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    repeated = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_quality_statistics(spark, docs, edge, labels):
    for df in (docs, edge):
        want = sorted(stats_by_hand(r.text or "") for r in df.select("text").collect())
        got = quality_rules.statistics(df)
        assert sorted(tuple(r)[1:6] for r in got.collect()) == want
    rules = quality_rules.learn_from(docs, labels)
    judged = quality_rules.judge(docs, rules)
    for r in judged.collect():
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.rule is None)
    kept = quality_rules.keep(docs, rules)
    assert kept.columns == docs.columns and kept.count() == judged.where("kept").count()
    assert quality_rules.keep(docs.limit(0), rules).count() == 0
    clash = edge.withColumn("n_words", edge.doc_id).withColumn("__quality", edge.doc_id)
    assert quality_rules.keep(clash, rules).columns == clash.columns


def test_decision_list_learns():
    rng = np.random.default_rng(1)
    stats = np.zeros((900, len(quality_rules.STATS)))
    stats[:, 0] = 100
    stats[:, 1] = 500
    bad = rng.random(900) < 0.2
    stats[bad, 2] = rng.integers(40, 90, bad.sum())
    stats[~bad, 2] = rng.integers(0, 20, (~bad).sum())
    rules = quality_rules.learn(stats, bad)
    assert rules and "symbols_per_word >" in str(rules[0])
    assert quality_rules.learn(stats[:0], bad[:0]) == [] and quality_rules.learn(stats, bad & False) == []


def test_secret_scan(spark, docs, edge):
    text = 'a PassWord : "abcDEF12+/" token=short api_key=AAAAAAAAAAAAAAAA AKIAABCDEFGHIJKL AKIA1 ' + "ab12" * 8 + " pwd: x9$kQz!8vLp2."
    fixed, spans = secret_scans.find(text)
    assert [k for *_, k in fixed] == ["assign", "assign", "access", "hex"] and [text[a:b] for a, b, k in spans if k == "guess"] == ["x9$kQz!8vLp2"]
    assert secret_scans.redact(text, "[x]", 8).count("[x]") == 5
    assert secret_scans.find("the password is thenation and token the ring")[1] == []
    for df in (docs, edge):
        rows = {(r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secret_scans.scan(df).collect()}
        want = set()
        for r in df.select("doc_id", "text").collect():
            t, found = r.text or "", []
            found += [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
            found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
            found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
            found.sort()
            spans = ",".join(f"{secret_scans.KINDS[k]}:{a}:{b}" for a, k, b in found)
            want.add((r.doc_id, hashlib.sha256(spans.encode()).hexdigest(), *(sum(k == i for _, k, _ in found) for i in range(3))))
        assert rows == want
    assert secret_scans.redacted(edge).columns == edge.columns and secret_scans.redacted(edge).where("text is null").count() == 1
    assert secret_scans.scan(docs.limit(0)).count() == 0


def test_long_secret_values():
    value = "".join("aZ3kQ9xLp7Rw"[i * i % 12] + "vT5" [i % 3] for i in range(700))
    text = f"Bearer {value} and more"
    assert [text[a:b] for a, b, _ in secret_scans.find(text)[1]] == [value]
    assert secret_scans.redact(text, "[x]", 8) == "Bearer [x] and more"
    inner = value[:400] + "_" + "ab12" * 8 + "_" + value  # a fixed span inside doesn't cover the value
    assert secret_scans.redact(f"Bearer {inner} and more", "[x]", 8) == "Bearer [x] and more"


@pytest.mark.parametrize("text", [
    "Authorization: Bearer {}", "authorization: basic {}", '"Authorization": "Token {}"', "DB_PASSWORD={}", "AWS_SECRET_ACCESS_KEY={}", "dbPassword: {}", "BEARER {}",
    "token_value = {}", "password: password: {}", "login: secret is {}", "MY-API-KEY-2 => {}",
])
def test_secret_contexts(text):
    value = "p@ss!w0rd#x9K+vB7qLz2"
    full = text.format(value)
    assert [full[a:b] for a, b, k in secret_scans.find(full)[1] if k == "guess"] == [value]
    assert secret_scans.find("the compass: northeast and author: unknownname")[1] == []


def plain_cost(value, spans):
    """The cheapest segmentation by trying all of them."""
    from functools import lru_cache

    each = lambda c: 1.0 if c.isdigit() else 1.42 if c.isalpha() and (c.islower() or c.isupper()) else 1.5

    @lru_cache(None)
    def rest(at, brute):
        if at == len(value):
            return 0.0
        ways = [each(value[at]) + (0 if brute or at == 0 else 1) + rest(at + 1, True)]
        ways += [cost + (1 if at else 0) + rest(b, False) for a, b, cost in spans if a == at]
        return min(ways)

    return rest(0, False)


def test_guess_cost_is_least():
    """Against all segmentations, where only ranked words and word-like runs are spans."""
    rank = secret_scans.ranks(["horse", "battery", "staple", "orse"])
    for value in ("correcthorsebattery", "h0rse!x9", "Batt3ryStaple7", "zqhorseq", "pa$$word1x"):
        spans = list(secret_scans._word_spans(value, value.lower(), rank))
        assert secret_scans.guess_cost(value, rank) == pytest.approx(plain_cost(value, spans)), value
    assert secret_scans.guess_cost("horsebattery", rank) < secret_scans.guess_cost("horsebattery") and secret_scans.guess_cost("p4ssw0rd!") < 6
    assert secret_scans.guess_cost("abc123abc123") < secret_scans.guess_cost("abc123xyq789")
    long = "Zq9!kX#w" * 3 + "".join("%x" % (i * 7919 % 4093) for i in range(9000))
    assert secret_scans.guess_cost(long) > secret_scans.guess_cost(long[:1000])
    assert secret_scans.redact(f"pwd: {long}, end", "[x]", 8) == "pwd: [x], end"
    # A value that reaches over a fixed span on both sides is masked whole.
    assert secret_scans.redact("pwd: Zq9!kX#" + "0a1b2c3d" * 4 + "$Wm7!vR2 end", "[x]", 8) == "pwd: [x] end"


def test_ranked_words(spark, docs, edge):
    rows = [(i, t) for i, t in enumerate(["Apple pear pear", "apple fig plum", None, "", "APPLE plum x1apple 12apple3", "mirabellemirabellemirabelle"])]
    df = spark.createDataFrame(rows, "n bigint, text string")
    assert secret_scans.ranked_words(df) == ["apple", "plum"] and secret_scans.ranked_words(df, size=1) == ["apple"]
    assert secret_scans.ranked_words(df.limit(0)) == [] and "lang" in secret_scans.ranked_words(edge.union(edge))
    words = secret_scans.ranked_words(docs)
    assert secret_scans.scan(docs, words=words).count() == docs.count()


def test_guess_cost_order():
    cost = secret_scans.guess_cost
    assert cost("aaaaaaaaaaaa") < cost("hunter2") < cost("x9$kQz!8vLp2") and cost("qwertyuiop") < 5 and cost("2024-01-31") <= 5
    assert cost("") == 0 and cost("k3!" * 400) > 0


def test_toxicity(spark, docs, labels, edge):
    data = "/root/testdata/sf0.01"
    many, marks = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    grammar = toxicity.learn(many, marks)
    rows = toxicity.score(many, grammar).join(marks, "doc_id").join(many.select("doc_id", "lang"), "doc_id").where("held_out AND lang = 'en'").collect()
    hits = [r.predicted == r.toxic for r in rows]
    assert len(rows) > 30 and np.mean(hits) >= 0.95
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in toxicity.score(many, grammar).collect())
    scored = toxicity.score(edge, grammar).collect()
    assert len(scored) == edge.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.learn(many, marks.where("toxic = 0")) == toxicity.DEFAULT
    assert toxicity.learn(many.limit(0), marks) == toxicity.DEFAULT and toxicity.score(many.limit(0), grammar).count() == 0


def test_toxicity_in_all_languages():
    """Held-out figures on the largest table, in every language."""
    from pyspark.sql import SparkSession

    spark, data = SparkSession.getActiveSession(), "/root/testdata/sf0.1"
    many, marks = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(many, toxicity.learn(many, marks)).join(marks, "doc_id").join(many.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    for english in (True, False):
        some = [r for r in rows if (r.lang == "en") == english]
        hits = [r.predicted for r in some if r.toxic]
        assert len(hits) > 30 and np.mean(hits) >= 0.9, english
        assert np.mean([r.predicted for r in some if not r.toxic]) <= 0.03, english


def paths(g, words):
    """The patterns of a clause, word by word, by looking around each word."""
    kinds = [g.kind(w) for w in words]
    out = Counter()
    for i, kind in enumerate(kinds):
        if kind not in (toxicity.INSULT, toxicity.THREAT):
            continue
        since = lambda k, reach: k in kinds[max(0, i - reach) : i]
        negated, meant = since(toxicity.NEGATION, toxicity.NEGATED), since(toxicity.MODAL, toxicity.MEANT)
        aimed = since(toxicity.TARGET, toxicity.AIMED) or toxicity.TARGET in kinds[i + 1 : i + 1 + toxicity.AIMED]
        reported = toxicity.REPORT in kinds[:i] + kinds[i + 1 :]
        if kind == toxicity.INSULT:
            out["insult_negated" if negated else "insult_reported" if reported else "insult_target" if aimed else "insult"] += g.weight(words[i])
        elif aimed and not negated and not reported:
            out["threat_target"] += 1.5 if meant else 1.0
        else:
            out["threat"] += 0.2
    return out


def test_composed_machine():
    """The composed transducers against a look around each word."""
    rng = np.random.default_rng(4)
    g = toxicity.Grammar({"idiot": 1.0, "scum": 2.5}, {"trot": 0.7}, 0.0, (0.0,) * 7)
    alphabet = ["idiot", "scum", "trottel", "kill", "stab", "you", "them", "not", "never", "said", "will", "gonna", *["word"] * 8]
    for _ in range(3000):
        words = [alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(0, 14))]
        assert g.clause(words) == pytest.approx(dict(paths(g, words))), words
    assert 40 < len(toxicity.BEFORE.moves) <= 4 * 5 * 2 * 4 and len(toxicity.AFTER.moves) == 5 * 2


def test_mostly_toxic_labels(spark):
    """Where most labels are positive words can still enter the lexicon."""
    rows = [(i, f"plain start {i} vile end") for i in range(80)] + [(100 + i, f"plain start {i} fine end") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(d, int("vile" in t)) for d, t in rows], "doc_id bigint, toxic int")
    g = toxicity.learn(df, marks)
    assert "vile" in g.words and g.score("a vile end") > g.score("a fine end")
    assert toxicity.learn(df.union(df), marks).words.keys() == g.words.keys()


def test_grammar_patterns():
    g = toxicity.DEFAULT
    assert set(g.clause("you are an idiot".split())) == {"insult_target"}
    assert set(g.clause("what a moron".split())) == {"insult"}
    assert set(g.clause("she is not stupid".split())) == {"insult_negated"}
    assert set(g.clause("the paper reported that a minister called it trash".split())) == {"insult_reported"}
    assert set(g.clause("we will kill you".split())) == {"threat_target"} and g.clause("a fine day".split()) == {}


def test_secrets_of_letters_alone():
    """Values of letters are judged by their cost, like others; words in such places stay."""
    for value in ("zqxjkvbwpfmtzzqk", "Zqxjkvbwpfmtzzqk", "ZQXJKVBWPFMTZZQK"):
        assert secret_scans.find(f"pwd: {value}")[1] == [(5, 21, "guess")]
    for value in ("required", "Passwort", "horses", "unbekannt", "necessary", "Monsieur"):
        assert secret_scans.find(f"pwd: {value} here")[1] == []


@pytest.mark.parametrize("size", [1, 3, 10, 1000])
def test_ranked_words_are_the_most_common(spark, docs, size):
    import re
    from collections import Counter

    texts = [r.text for r in docs.select("text").collect()] + [None, ""]
    n = Counter(w for t in texts for w in set(re.findall(r"(?<![^\W\d_])[^\W\d_]{4,16}(?![^\W\d_])", (t or "").lower())))
    want = sorted((w for w, k in n.items() if k > 1), key=lambda w: (-n[w], w.encode()))[:size]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert secret_scans.ranked_words(df, size=size) == want
    assert secret_scans.ranked_words(df.limit(0)) == []
