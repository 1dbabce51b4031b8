import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from support import SF0001
from quire.llm import license_rules as L


def base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def test_base_columns_equal_brute_force_on_documents(spark):
    rows = L.scan(spark.read.parquet(f"{SF0001}/documents.parquet")).collect()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(r.text)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert any(r.n_base for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["GNU", "general", "Public", "license", "apache", "cc", "by", "mit", "é", "1", " ", "-", "\n", "x", " "]), max_size=14))
def test_base_columns_of_any_text(parts):
    text = "".join(parts)
    assert L.scan_text(text)[:5] == base(text)


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_no_gate_turns_away_what_its_rule_matches(data):
    rule = data.draw(st.sampled_from(L.rules()))
    text = data.draw(st.from_regex(rule.pattern))
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    assert not rule.pattern.search(text) or any(k in L.plain(text) for k in rule.keywords), (rule, text)


def ungated(text):
    """Labels by definition: every rule on every text, and containment by comparing all pairs."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = []
    for rule in L.rules():
        for m in rule.pattern.finditer(low):
            version = m.groupdict().get("v")
            label = " ".join(m[0].split()[1:]) if rule.label == "spdx" else f"{rule.label}-{version}" if version else rule.label
            found.append((m.start(), m.end(), label, rule.confidence, rule.priority))
    found.sort(key=lambda d: (d[4], d[0] - d[1], d[0]))
    kept = []
    for d in found:
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            kept.append(d)
    return {d[2] for d in kept}


def test_labels_equal_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    rng = random.Random(6)
    notices = ["Permission is hereby granted, free of charge, to any person obtaining a copy", "All rights reserved.", "Licensed under the EUPL",
               "SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0", "or (at your option) any later version", "see COPYING for details",
               "under the GNU General Public License version 3", "CC BY-SA 4.0", "https://opensource.org/licenses/MIT", "the MIT License"]
    texts += [" ".join(rng.choice(notices + ["and", "\n\n", "x"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for t in texts:
        r = L.scan_text(t)
        assert set(filter(None, r[5].split(","))) == ungated(t) | set(filter(None, r[4].split(",")))


def test_blank_lines_take_linear_time():
    start = time.process_time()
    L.scan_text("\n" * 5_000_000 + "license: mit license" + " \n" * 2_000_000)
    assert time.process_time() - start < 30


def test_hand_written_signatures():
    assert len(L.SIGNATURES) >= 200
    say = lambda t: L.scan_text(t)[5]
    assert say("Neither the name of the X nor the names of its contributors may be used to endorse or promote") == "bsd-3-clause"
    assert say("SPDX-License-Identifier: MIT") == "mit" and say("See the LICENSE file in the root") == "license-file"
    assert say("either version 3 of the License, or (at your option)\nany later version") == "gpl-3-or-later"
    assert say("http://creativecommons.org/licenses/by-nc-sa/4.0/") == "cc-by-nc-sa"


def test_rules_priority_and_containment():
    assert 200 < len(L.rules()) < 1000
    say = lambda t: L.scan_text(t)[5]
    assert say("Licensed under the Apache License, Version 2.0.") == "apache,apache-2.0"
    assert say("SPDX-License-Identifier: AGPL-3.0") == "agpl-3.0"
    assert say("Licensed under CC BY-NC 4.0.") == "cc-by,cc-by-nc-4.0"
    assert say("the GNU Lesser General Public License, version 2.1") == "lgpl-2.1"
    assert say("All rights\n reserved.") == "proprietary" and say("mit der Bahn, gnus und Apachen") == ""
    assert say("MIT \n  License") == "mit" and say("under cc - by") == "cc-by" and say("ISC\nLicence") == "isc"
    full, mention = (L.scan_text(t)[6] for t in ("Released under the MIT License.", "the MIT License"))
    assert 0.5 < mention < full <= 1 and L.scan_text("nothing here")[6] == 0


def test_suppression_equals_the_plain_rule():
    rng = random.Random(4)
    for _ in range(300):
        found = []
        for p in range(rng.randint(0, 12)):
            a = rng.randint(0, 20)
            found.append((a, a + rng.randint(1, 9), "x", 0.5, p))
        plain = []
        for d in found:
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in plain):
                plain.append(d)
        assert L.suppress(found) == plain


def test_nulls_long_texts_clashing_columns_and_empty_tables(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x " * 500_000 + "MIT License", "a"), (2, "", "a")]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert sorted((r.n_words, r.n_base, r.labels, r.score > 0) for r in got) == [
        (0, 0, "", False)] * 3 + [(500_002, 1, "mit", True)]
    assert [r.first_word for r in got if r.n_base] == [500_000]
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
