import pytest

from weftline.operators import libraries

MATERIAL = """import Btn from '@mui/material/Button';
import { Box, Card as Panel, styled } from "@mui/material";
import { ThemeProvider } from '@mui/material/styles';
// <Box/>
export const A = ({ xs }) => <Box sx={{ p: 1, q: { r: '>' } }} p={2}>
  <Btn onClick={() => go('<Box/>')} /> <Panel.Item /> <Box {...xs} /> <Typography>it is</Typography>
</Box>;
const x = useState<Card>(1);
"""
KIT = """import { Button as B, Badge, Form } from '@/components/ui/button';
import Alert from "../x/ui/alert";
import { Sun } from 'lucide-react';
export const A = () => <div className="p-1 dark:p-2"><B variant="ghost" size="sm">x</B><B variant="odd" size="huge"/>
  <Badge variant={v} /><Alert variant='destructive'/><Form variant="free"/></div>;
"""
PRIMITIVES = """import * as Dialog from '@radix-ui/react-dialog';
import { Select, SelectTrigger, Other } from '@radix-ui/react-select';
import { Slot } from '@radix-ui/react-slot';
export const A = () => <Dialog.Root open={o} modal><Dialog.Trigger asChild><b/></Dialog.Trigger><Dialog.Portal><Dialog.Content open={o} dir="rtl"/></Dialog.Portal>
  <Select defaultValue="a" orientation="vertical"><SelectTrigger asChild/></Select></Dialog.Root>;
"""


@pytest.fixture(scope="module")
def rows(spark):
    long = "import { Button } from '@mui/material';\nexport const A = () => <Button " + " ".join(f"a{k}={{{k}}}" for k in range(10000)) + ' label="' + "x" * 200000 + '" />;\n' + "<Button/>" * 2000
    texts = [("material", MATERIAL), ("kit", KIT), ("primitives", PRIMITIVES), ("long", long), ("open", "<Button a={ b=' "), ("empty", ""), ("none", None)]
    df = spark.createDataFrame(texts, "path string, text string")
    return {r["path"]: r.asDict(recursive=True) for r in libraries.ui_libraries(df).collect()}


def test_material(rows):
    m = rows["material"]["material"]
    assert m["components"] == ["Box", "Button", "Card", "Typography"]
    assert m["packages"] == ["@mui/material", "@mui/material/Button", "@mui/material/styles"]
    assert (m["theme"], m["sx"], m["styled"], m["make_styles"], m["system_props"]) == (True, True, False, False, True)
    assert rows["long"]["material"]["components"] == ["Button"]


def test_kit(rows):
    k = rows["kit"]["kit"]
    assert k["components"] == ["Button", "Alert", "Badge", "Form"]
    assert [(v["type"], v["values"]) for v in k["variants"]] == [("alert", ["destructive"]), ("button", ["ghost"]), ("other", ["free"])]
    assert (k["sizes"], k["form"], k["theme"], k["icons"], k["density"]) == (["sm"], True, True, True, "medium")


def test_primitives(rows):
    p = rows["primitives"]["primitives"]
    assert [(x["package"], x["components"]) for x in p["primitives"]] == [("react-dialog", ["Dialog.*"]), ("react-select", ["Select", "SelectTrigger"])]
    assert (p["controlled"], p["uncontrolled"], p["portals"], p["as_child"]) == (["DialogContent"], ["Select"], 1, 2)
    assert (p["direction"], p["focus"], p["keyboard"], p["modal"], p["primitive_count"], p["depth"]) == (True, False, True, True, 3, "simple")


def test_nothing_used(rows):
    assert rows["none"]["material"] is None and rows["none"]["kit"] is None and rows["none"]["primitives"] is None
    for path in ("empty", "open", "kit"):
        m, p = rows[path]["material"], rows[path]["primitives"]
        assert (m["components"], m["packages"], m["sx"], p["primitives"], p["depth"], p["primitive_count"]) == ([], [], False, [], None, 0)
    assert rows["primitives"]["kit"]["density"] is None
