import re
import textwrap


from gaugewright.llm import licenses
from gaugewright.llm.common import letter_words


def brute(text, least=0.8):
    w = [x.decode() for x in letter_words(text)]
    places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    base = sorted({label for _, label in places})
    more, best = set(base), 0.0
    for line in (text or "").split("\n"):
        block = {x.decode() for x in letter_words(line)}
        for label, template in licenses.TEMPLATES:
            t = set(template.split())
            if len(block & t) >= licenses.required(len(t), least):
                more.add(label)
                best = max(best, len(block & t) / len(t))
    at = [i for i, _ in places]
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted(more)), 1.0 if places else best)


def test_like_brute_force(awkward, none):
    got = sorted([tuple(r) for r in licenses.scan(awkward).collect()], key=repr)
    assert got == sorted([(r["doc_id"], *brute(r["text"])) for r in awkward.collect()], key=repr)
    assert licenses.scan(none).count() == 0


def test_partial_notices(spark):
    notice = dict(licenses.TEMPLATES[::-1])["mit"]
    long = next(t for label, t in licenses.TEMPLATES if label == "mit" and len(t) > 60)
    words = long.split()
    texts = [long, " ".join(words[4:]), " ".join(words[: len(words) // 2]), " ".join(reversed(words)), long.replace(" ", "\n"), notice.upper(),
             "K mit license", "the mit\nlicense", "mit license mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(df).collect():
        assert tuple(r)[1:] == brute(texts[r["doc_id"]])


def test_no_python(awkward):
    plan = licenses.scan(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_other_licenses_get_no_label(spark):
    texts = {
        "Released under the Apache License.": "apache", "Released under the BSD license.": "", "Licensed under CC BY 4.0": "",
        "CC BY-SA 4.0": "", "Licensed under CC BY-SA 4.0": "", "Licensed under the Mozilla Public License, Version 2.0.": "",
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "",
        "This work is licensed under the GNU Free Documentation License, version 3": "",
        # A word that decides nothing may be missing.
        "Released under MIT": "", "Released under the license MIT": "mit", "Licensed under CC BY-NC 3.0": "cc-by-nc",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {list(texts)[r["doc_id"]]: r["labels"] for r in licenses.scan(df).collect()}
    assert got == texts


def wrapped_brute(text, least=0.8):
    """As brute(), with every run of consecutive words as a block."""
    w = [x.decode() for x in letter_words(text)]
    own = brute(text)
    more, best = set(filter(None, own[4].split(","))), 0.0
    for label, template in licenses.TEMPLATES:
        t, run = set(template.split()), licenses.run_length(template)
        for i in range(len(w)):
            found = t & set(w[i : i + run])
            if len(found) >= licenses.required(len(t), least) and licenses.DECIDING.get(label, set()) & t <= found:
                more.add(label)
                best = max(best, len(found) / len(t))
    return (*own[:5], ",".join(sorted(more)), 1.0 if own[1] else best)


def test_wrapped_notices(spark, awkward):
    long = [t for _, t in licenses.TEMPLATES if len(t) > 80]
    labels = [label for label, t in licenses.TEMPLATES if len(t) > 80]
    wrapped = ["intro words here\n * " + "\n * ".join(textwrap.wrap(t, 40)) + "\nand more" for t in long]
    far = " ".join(f"{w} " + " ".join(f"x{i}" for i in range(40)) for w in "released under the mit license".split())  # scattered words
    texts = [*wrapped, "filler " * 1000 + long[0].replace(" ", "\n") + " filler" * 1000, far, "the of " * 500 + "\n".join(long), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(df, wrapped=True).collect()}
    assert got == {i: wrapped_brute(t) for i, t in enumerate(texts)}
    for i, label in enumerate(labels):
        assert label in got[i][5].split(",")
    assert got[len(long)][5] == "mit" and got[len(long) + 1][5] == ""
    rows = sorted([tuple(r) for r in licenses.scan(awkward, wrapped=True).collect()], key=repr)
    assert rows == sorted([(r["doc_id"], *wrapped_brute(r["text"])) for r in awkward.collect()], key=repr)
    assert licenses.scan(awkward.limit(0), wrapped=True).count() == 0
    plan = licenses.scan(awkward, wrapped=True)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
