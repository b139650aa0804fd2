"""Lines made normal a text at a time, and the size of the code that makes their keys."""

import re

from arborel.llm import lines
from arborel.llm.common import MAX_ID, prepare

TEXT = "ΟΔΟΣ\nΣ!\r\n--- ...\n\n  Ab,\tc -\u000b DK\n ÄÖ x   y \x7f\n\x00\nİ_Q"


def test_generated_methods_are_small_enough_to_be_compiled(spark, capsys):
    prepare(spark)
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan's code can't be shown otherwise
    try:
        lines.keyed_lines(lines.occurrences(docs)).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


def test_lines_are_normal_as_each_by_itself(spark):
    prepare(spark)
    docs = spark.createDataFrame([(2, TEXT), (None, "A\nb"), (3, None), (4, "")], "doc_id long, text string")
    found = {(r.id, r.place, r.normal, r.words) for r in lines.occurrences(docs).collect()}
    marks = "".join(re.escape(chr(i)) for i in range(128) if not chr(i).isalnum())
    wanted = set()
    for i, text in ((2, TEXT), (MAX_ID, "A\nb")):
        for place, line in enumerate(text.split("\n")):
            own = re.sub(f"[{marks}]+", " ", line.lower()).strip(" ")
            if own:
                wanted.add((i, place, own, own.count(" ") + 1))
    assert found == wanted
