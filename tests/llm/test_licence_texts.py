from loomq.llm import licence_scan as ls
from loomq.llm import queries
from loomq.llm.licence_texts import FOLDER, common

from llm_cases import SCHEMA


def test_op7_knows_the_common_licences(spark, tmp_path):
    whole = {f.name.removesuffix(".txt"): f.read_text() for f in FOLDER.glob("*.txt")}
    untitled = {"Apache-2.0": whole["Apache-2.0"][whole["Apache-2.0"].index("TERMS AND CONDITIONS FOR") :].partition("   END OF TERMS")[0], "MPL-2.0": whole["MPL-2.0"].partition("----\n\n")[2]}
    untitled["MPL-2.0"] = "1. Definitions\n" + untitled["MPL-2.0"]
    titled = {k: f"{t}\n\nCopyright (c) 2020 Some One\nAll rights reserved.\n\n{ls.KNOWN.get(k) or whole[k]}" for k, t in {"MIT": "MIT License", "ISC": "ISC License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License"}.items()}
    temple = {"GPL-2.0": whole["GPL-2.0"].replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA")}
    bulleted = {"BSD-3-Clause": whole["BSD-3-Clause"].replace("1. R", "* R").replace("2. R", "* R").replace("3. N", "* N"), "BSD-2-Clause": whole["BSD-2-Clause"].replace("* R", "1. R", 1).replace("* R", "2. R", 1)}
    cases = [x for d in (whole, untitled, titled, temple, bulleted) for x in d.items()]
    spark.createDataFrame([(k, t, None, None) for k, (_, t) in enumerate(cases)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.licence for r in queries.op7_licence_scan(spark, str(tmp_path)).collect()}
    assert [(n, got[k]) for k, (n, _) in enumerate(cases)] == [(n, n) for n, _ in cases]
    assert len(whole) == 19 and common().keys() >= ls.KNOWN.keys()
