"""Facts of Go and TypeScript text."""

from gaugeworks.parse.brace_facts import brace_facts, go_facts, script_facts

GO = '''package lib

import (
	"fmt"
	m "net/http"
)

// Used does.
func Used(a int) int {
	if a > 1 && a < 5 || a == 9 { // if
		return 1
	}
	for i := 0; i < a; i++ {
		switch i {
		case 1:
			fmt.Println("if for case")
		default:
		}
	}
	return 0
}

type T struct{ x int }

func (t *T) Get() string { return `
if` }

func TestUsed(t *testing.T) {
	if Used(1) != 0 {
		t.Errorf("no")
	}
	assert.Equal(t, 1, 1)
}
'''
TS = '''import def, { a as b, c } from "./x";
import * as ns from 'y';
const fs = require("fs");
export function add(p: number, q?: number): number {
  return q ? p + q : p;
}
export class K {
  get(v: string): string { if (v && v.length > 1) { return v?.trim() ?? ""; } return v; }
}
export const run = async (x: number) => {
  for (const y of [1]) { try { add(y); } catch (e) { } }
  const inner = () => { if (x) return; };
};
export { add as plus };
describe("s", () => { it("should add", () => { expect(add(1)).toBe(1); expect(2).not.toBe(3); assert.ok(1); }); });
'''


def collected(facts):
    out = {}
    for kind, name, _line, _end, value, extra in facts:
        out.setdefault(kind, {})[name] = (value, extra)
    return out


def test_go():
    got = collected(go_facts(GO))
    assert {k: v[0] for k, v in got["function"].items()} == {"Used": 6, "T.Get": 1, "TestUsed": 2}
    assert set(got["import"]) == {"fmt", "net/http"} and got["test"]["TestUsed"][0] == 2
    assert got["export"]["Used"] == (1, "func") and got["export"]["T"] == (0, "type") and "TestUsed" not in got["export"]
    assert got["reference"]["Println"][1] == "fmt" and set(got["package"]) == {"lib"}


def test_typescript():
    got = collected(script_facts(TS))
    assert got["function"]["add"][0] == 2 and got["function"]["K.get"][0] == 4 and got["function"]["run"][0] == 4
    assert "inner" not in got["function"]
    assert set(got["import"]) == {"./x", "y", "fs"} and {"def", "a", "c", "ns"} <= set(got["imported_name"])
    assert {"add", "K", "run", "plus"} <= set(got["export"])
    assert got["test"]["should add"][0] == 3 and got["optional_chain"][""][0] == 1


def test_damaged_text_gives_what_it_can():
    assert list(go_facts("func (")) == []
    for text in ("", "func", "func f(", "class {", "import", "export", "`open", "a => {", "it("):
        list(go_facts(text)), list(script_facts(text))


def test_as_table(spark):
    rows = spark.createDataFrame([("r", "a.go", GO.encode()), ("r", "b.ts", TS.encode()), ("r", "c.py", b"x"), ("r", "d.go", None)], "repo_id string, rel_path string, content binary")
    got = brace_facts(rows).where("kind = 'function'").groupBy("file").count().collect()
    assert {r[0]: r[1] >= 3 for r in got} == {"a.go": True, "b.ts": True}
