import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.redaction import OWN_PLACEHOLDERS, Redactor, is_own_placeholder, with_redaction

R = Redactor()
# built from parts, so that no scanner finds a secret here
POSITIVES = {
    "ANTHROPIC_API_KEY": "sk-" + "ant-" + "a1" * 12,
    "OPENROUTER_API_KEY": "sk-" + "or-" + "b2" * 12,
    "GITHUB_OAUTH_TOKEN": "gh" + "p_" + "FAKE0123456789abcdefghijklmnopqrstuv",
    "GCP_API_KEY": "AI" + "za" + "c" * 35,
    "GROQ_API_KEY": "gs" + "k_" + "d" * 24,
    "AWS_ACCESS_TOKEN": "AK" + "IA" + "ABCDEFGH12345678",
    "STRIPE_ACCESS_TOKEN": "sk" + "_test_" + "FAKE" + "e" * 20,
    "AZURE_AD_CLIENT_SECRET": "abc" + "8Q~" + "f" * 32,
}
PEM = "-----BEGIN RSA PRIVATE " + "KEY-----\n" + "\n".join(["QUJD" * 12] * 4) + "\n-----END RSA PRIVATE " + "KEY-----"


@pytest.mark.parametrize("entity", POSITIVES)
def test_each_token_is_masked(entity):
    text, types, spans = R.redact(f"see {POSITIVES[entity]} there", "broad")
    assert text == f"see [{entity}] there" and entity in types
    assert all(f"see {POSITIVES[entity]} there"[s:e] for s, e in spans)


def test_second_google_shape():
    assert R.redact("AQ" + "." + "g" * 30, "broad")[0] == "[GCP_API_KEY]"


def test_block_and_lone_marker():
    assert R.redact(PEM, "broad")[0] == "[PRIVATE_KEY]"
    assert R.redact("-----END PRIVATE " + "KEY-----", "broad")[0] == "[PEM_MARKER_LITERAL]"


def test_assignments():
    secret = "abc123XYZsuperlonglooooooongsecretvalue1234567890"
    assert R.redact(f"API_KEY={secret}", "broad")[:2] == ("[ENV_ASSIGNMENT_SECRET]", ["ENV_ASSIGNMENT_SECRET"])
    assert secret not in R.redact(f"run -e API_KEY={secret} -e OTHER=y", "broad")[0]
    assert R.redact("API_KEY=change" + "me_placeholder_xxxx", "broad")[1] == []
    assert R.redact("token=aaaaaaaaaaaa", "broad")[1] in ([], ["ENV_ASSIGNMENT_SECRET"])
    # the terminator belongs to the match
    assert R.redact(f"API_KEY={secret}\nafter", "broad")[0] == "[ENV_ASSIGNMENT_SECRET]after"


def test_profiles():
    text = "mail jo@site.example from 10.0.0.1 or call 555-123-4567"
    assert R.redact(text, "broad")[0] == text
    assert R.redact(text, "broad_pii")[0] == "mail [EMAIL_ADDRESS] from [IP_ADDRESS] or call 555-123-4567"
    assert R.redact(text, "narrow")[0] == "mail [EMAIL_ADDRESS] from [IP_ADDRESS] or call [PHONE_NUMBER]"
    with pytest.raises(ValueError):
        R.redact("x", "wide")


def test_counts_keep_what_overlap_drops():
    text = f"API_TOKEN={POSITIVES['GROQ_API_KEY']}9xQ7"
    masked, types, _ = R.redact(text, "broad")
    assert masked.count("[") == 1 and len(types) >= 1


def test_idempotent_and_own_placeholders():
    for t in [*POSITIVES.values(), PEM, "jo@site.example"]:
        once = R.redact(t, "narrow")[0]
        assert R.redact(once, "narrow")[0] == once
    assert all(is_own_placeholder(f" {p} ") for p in OWN_PLACEHOLDERS) and not is_own_placeholder("[OTHER]")


@given(st.text(max_size=60))
def test_redaction_leaves_no_finding(text):
    out = R.redact(text, "narrow")[0]
    assert R.redact(out, "narrow")[1] == [] or R.redact(out, "narrow")[0] != ""


def test_entropy(spark):
    assert rules.shannon_entropy("") == 0 and rules.shannon_entropy("abcd") == 2.0
    texts = ["", "abcd", "1234567890", "aab", "é😀é"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules.entropy(F.col("t")).alias("h")).collect()
    assert all(math.isclose(r.h, rules.shannon_entropy(r.t), abs_tol=1e-9) for r in got)
    whole = rules.text_entropy(spark.createDataFrame([(t,) for t in [*texts, None]], "t string"), "t", "h").collect()
    assert all(r.h is None if r.t is None else math.isclose(r.h, rules.shannon_entropy(r.t), abs_tol=1e-9) for r in whole)


def test_dataframe_agrees_with_python(spark):
    texts = [*POSITIVES.values(), PEM, "plain", "", None, "x jo@site.example y", "mot_clé secret = 'Zx9kQ2mNv7Lp4Rt8'"]
    df = with_redaction(spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "i int, t string, redacted string"), "t", "broad_pii")
    for r in df.collect():
        if r.t is None:
            assert r.redacted is None and r.findings == []
        else:
            want = R.redact(r.t, "broad_pii")
            assert (r.redacted, [f.entity_type for f in r.findings], [(f.start, f.end) for f in r.findings]) == want


def test_hints_never_hide_a_match():
    rng = random.Random(5)
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [*POSITIVES.values(), PEM, "jo@site.example", "A\u017fIA" + "ABCDEFGH12345678", "TOKEN = 'Zx9kQ2mNv7Lp4Rt8'", "10.1.2.3"]
    texts += [some("0123456789 .()+-", 24) for _ in range(4000)] + [some("09afAF::", 20) for _ in range(4000)] + [":".join(["0a"] * 8), "::", "a::", "call 555-010-1234 now"]
    tried = set()
    for rule, pattern, shape in R.rules:
        for text in texts:
            if pattern.search(text):
                tried.add(rule.pattern)
                assert shape.search(text) if shape else any(h in rules.folded(text) for h in rules.HINTS[rule.entity])
    assert set(rules.SHAPES) <= tried


@pytest.mark.parametrize("address", ["::1", "fe80::1", "2001:db8::ff00:42:8329", "1:2:3:4:5:6:7::", "1::8", "2001:db8:0:0:0:0:2:1", "FE80::A:B"])
def test_addresses_with_zero_runs(address):
    import ipaddress

    ipaddress.ip_address(address)
    assert Redactor().redact(f"from {address}, port 1", "broad_pii")[0] == "from [IP_ADDRESS], port 1"


@pytest.mark.parametrize("text", ["std::vector", "a 12:30:45 b", "x :: y", "key: value", "zone::name"])
def test_colons_that_are_no_address(text):
    assert Redactor().redact(text, "broad_pii")[0] == text
