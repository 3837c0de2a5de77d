"""Template files by rendered names, folders and patterns."""

from __future__ import annotations

import pytest
from compare import rows
from pyspark.sql import functions as F

from sweepframe import Space, StudyError
from sweepframe.operators.context import contexts
from sweepframe.sources import filemaps
from sweepframe.sources.filemaps import FileMap, mapped_files


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "source files"
    for name, text in {
        "file-a.txt": "This is file a\n${bravo} and ${alpha * 2}\n",
        "file-b.txt": "This is file b\n${bravo} and ${alpha + 1}\n",
        "file-c.txt": "no holes é\n",
        "lib/x.txt": "x=${alpha}",
        "lib/deep/.y.txt": "y=${bravo}",
        "lib/deep/[z].md": "z",
        "div.txt": "${1 / (alpha - 1)}",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def points(spark, **axes):
    return contexts(spark, Space({"alpha": [1, 2, 3], "bravo": ["a", "b", "c"], **axes}))


def own(row):
    return {"a": f"This is file a\na and {row['alpha'] * 2}\n", "b": f"This is file b\nb and {row['alpha'] + 1}\n", "c": "no holes é\n"}[row["bravo"]]


RAW = {"a": "This is file a\n${bravo} and ${alpha * 2}\n", "b": "This is file b\n${bravo} and ${alpha + 1}\n", "c": "no holes é\n"}


def test_sources_chosen_by_the_context(spark, tree):
    grid = points(spark)
    maps = [FileMap("file-${bravo}.txt", template=True), FileMap("./file-${bravo}.txt", "non/${alpha}/f.txt")]
    wanted = [
        (r["g_index"], target, text)
        for r in grid.collect()
        for target, text in ((f"file-{r['bravo']}.txt", own(r)), (f"non/{r['alpha']}/f.txt", RAW[r["bravo"]]))
    ]
    assert rows(mapped_files(grid, tree, maps), "g_index", "target") == sorted(wanted)


def test_folders_and_patterns(spark, tree):
    grid = points(spark).where("bravo = 'a'")
    found = rows(mapped_files(grid, tree, [FileMap("lib", "to", template=True), FileMap("lib/*", mode="glob"), FileMap("*[[]z*", "g/${bravo}", mode="glob"), FileMap("${bravo}/none*", mode="glob")]), "g_index", "target")
    wanted = []
    for r in grid.collect():
        wanted += [(r["g_index"], f"to/{name}", text) for name, text in (("x.txt", f"x={r['alpha']}"), ("deep/.y.txt", "y=a"), ("deep/[z].md", "z"))]
        wanted += [(r["g_index"], f"lib/{name}", text) for name, text in (("x.txt", "x=${alpha}"), ("deep/.y.txt", "y=${bravo}"), ("deep/[z].md", "z"))]
        wanted += [(r["g_index"], "g/a/lib/deep/[z].md", "z")]
    assert found == sorted(wanted)
    whole = mapped_files(grid, tree, [FileMap(".")])
    assert whole.count() == 3 * 7 and whole.where("target = 'lib/deep/[z].md'").count() == 3


def test_missing_files(spark, tree):
    grid = points(spark, charlie=["a", "nope"])
    with pytest.raises(StudyError, match="missing files: .*file-nope.txt"):
        mapped_files(grid, tree, [FileMap("file-${charlie}.txt")])
    found = mapped_files(grid, tree, [FileMap("file-${charlie}.txt")], ignore_missing=True)
    assert found.count() == 9
    with pytest.raises(StudyError, match="mode"):
        FileMap("a", mode="regex")


def test_expressions_of_other_templates_are_not_evaluated(spark, tree):
    grid = points(spark, which=["div", "file-a"]).where("which <> 'div' or alpha > 1")
    found = rows(mapped_files(grid, tree, [FileMap("${which}.txt", "t", template=True)]), "g_index")
    assert [r[2] for r in found if "This" not in r[2]] == ["1.0"] * 3 + ["0.5"] * 3
    assert len(found) == grid.count()
    # Columns named like internal ones, no points, and only plain files.
    named = grid.withColumns({"path": F.lit(1), "text": F.lit(2), "target": F.lit(3), "entry": F.lit(4), "source": F.lit(5)})
    assert rows(mapped_files(named, tree, [FileMap("${which}.txt", "t", template=True)]), "g_index") == found
    assert mapped_files(grid.where("false"), tree, [FileMap("${which}.txt", template=True)]).count() == 0
    assert {r[2] for r in rows(mapped_files(grid, tree, [FileMap("file-c.txt", template=True)]))} == {"no holes é\n"}


def test_each_file_is_read_and_split_once(spark, tree, monkeypatch):
    reads = []
    plain = filemaps.read_files

    def noting(files, root):
        reads.append(sorted(r["path"] for r in files.collect()))
        return plain(files, root)

    monkeypatch.setattr(filemaps, "read_files", noting)
    grid = contexts(spark, Space({"alpha": list(range(33_334)), "bravo": ["a", "b", "c"]}))
    documents = mapped_files(grid, tree, [FileMap("file-${bravo}.txt", template=True), FileMap("file-${bravo}.txt", "raw")])
    assert reads == [["file-a.txt", "file-b.txt", "file-c.txt"]]
    checked = documents.join(grid.select("g_index", "alpha", "bravo"), "g_index").where("bravo = 'b' and target <> 'raw'")
    assert documents.count() == 2 * 100_002
    assert checked.where("text <> concat('This is file b\\nb and ', alpha + 1, '\\n')").count() == 0 and checked.count() == 33_334
    monkeypatch.setattr(filemaps, "MAX_EXPRESSIONS", 2)
    with pytest.raises(StudyError, match="distinct expressions"):
        mapped_files(grid, tree, [FileMap("file-${bravo}.txt", template=True)])
