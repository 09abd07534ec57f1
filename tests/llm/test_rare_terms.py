"""The lexicon of operator 4 takes rare terms, however many labelled rows there are."""

import random
import zlib

from quillhouse.llm import toxicity


def test_rare_terms_of_a_large_sample(spark):
    r = random.Random(4)
    filler = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    fit = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 5]
    toxic, clean = fit[:2000], fit[2000:6000]

    def spelled(k):
        at = r.randrange(7)
        return "zounderkite" if k < 9 else "scumbag" if k % 3 else "scumbag"[:at] + r.choice("ijklmnopqrstuvwxyz") + "scumbag"[at + 1 :]

    rows = [(i, " ".join([*r.choices(filler, k=12), spelled(k)])) for k, i in enumerate(toxic)]
    rows += [(i, " ".join(r.choices(filler, k=12))) for i in clean]
    labels = [(i, 1, 1) for i in toxic] + [(i, 1, 0) for i in clean]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    # Nine rows of 2,000 hold the one term.
    assert {"scumbag", "zounderkite"} <= set(model.terms)
    said = [" ".join([*r.choices(filler, k=12), w]) for w in ("zounderkite", "zounderkyte", "scumbag", filler[0])]
    assert [model.score(x) >= 0.5 for x in said] == [True, True, True, False]
