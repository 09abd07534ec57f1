"""Quality rules on clean texts with a phrase or a mark of emphasis in them."""

from quillhouse.llm import quality


def test_one_phrase_does_not_condemn_a_long_line(spark):
    said = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(k, k + 400)) for k in (0, 401)]
    prose = f"{said[0]} click here and read more about engines powered by steam {said[1]}"
    rows = [(1, prose), (2, f"{said[0]}\nWell done!\nThey were empowered by it"), (3, f"{said[0]}\nCopyright 2020 Acme. All rights reserved.\n!!\n## ** || a b c d"), (4, "\n".join(["Click here to read more"] * 12))]
    out = {r.doc_id: r.quality for r in quality.line_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1].kept, out[1].n_lines_dropped, out[1].clean_text) == (True, 0, prose)
    assert (out[2].kept, out[2].n_lines_dropped) == (True, 0)
    assert out[3].kept and out[3].n_lines_dropped == 3 and out[3].clean_text == said[0]
    assert not out[4].kept
