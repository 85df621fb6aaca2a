"""The ladder on a small project, with one file per way of importing."""

from vigil.operators import reachability as R

FILES = {
    "a.js": "const _ = require('lodash');\n_.merge(a, b); x_.merge(c)\n_.set\n",
    "b.ts": "import { sign, verify as v } from 'jsonwebtoken'\nv(token, key)\nsign\n",
    "c.mjs": "import axios from 'axios'\naxios.post(u)\n// __proto__\n",
    "d.py": "import requests as r, os\nr.get(url)\nfrom yaml import (load, dump)\nload (x)\n",
    "e.go": 'import (\n\tj "github.com/dgrijalva/jwt-go"\n\t"golang.org/x/net/html"\n)\nj.Parse(t)\nhtml.Parse(t)\n',
    "F.java": "import org.apache.log4j.Logger;\nLogger.info(x);\n",
    "g.js": "const express = require('express')\napp.use(express.urlencoded({extended: true}))\n",
    "h.js": "const minimist = require('minimist')\nminimist(process.argv)\n",
    "i.txt": "const _ = require('lodash'); _.merge(a)\n",
    "j.js": None,
    "k.py": "import mylodash\nfrom .local import merge\nmerge(x)\n",
}
ADVISORIES = [
    ("lodash", "lodash", "npm", ["merge", "set"], [], [], ["__PROTO__"]), ("jwt", "JsonWebToken", "npm", ["verify"], [], [], ["nothing"]), ("axios", "axios", "npm", ["get"], [], [], []), ("requests", "requests", "pip", ["get"], [], [], ["cert_none"]),
    ("yaml", "yaml", "pip", ["load"], [], [], []), ("go", "jwt", "go", ["Parse"], [], [], []), ("net", "x/net", "go", ["Parse"], [], [], []), ("log4j", "log4j", "maven", ["error"], [], [], []), ("express", "express", "npm", [], [], ["urlencoded"], ["extended: true"]),
    ("minimist", "minimist", "npm", [], [r"\bminimist\s*\("], [], []), ("left", "left-pad", "npm", ["x"], [], [], []),
]
SCHEMA = "cve string, package string, ecosystem string, functions array<string>, call_patterns array<string>, middleware array<string>, indicators array<string>"


def test_ladder(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    got = {r.cve: (r.exploitability, r.n_imports, r.n_usages) for r in R.ladder(files, spark.createDataFrame(ADVISORIES, SCHEMA)).collect()}
    assert got == {
        "lodash": ("exploitable", 1, 1), "jwt": ("potentially_exploitable", 1, 1), "axios": ("imported_only", 1, 0), "requests": ("potentially_exploitable", 1, 1), "yaml": ("potentially_exploitable", 1, 1),
        "go": ("potentially_exploitable", 1, 1), "net": ("potentially_exploitable", 1, 1), "log4j": ("imported_only", 1, 0), "express": ("exploitable", 1, 1), "minimist": ("potentially_exploitable", 1, 1), "left": ("not_reachable", 0, 0),
    }
    assert R.ladder(files.limit(0), spark.createDataFrame(ADVISORIES[:1], SCHEMA)).first().exploitability == "not_reachable"


def test_imports(spark):
    lines = {
        "a.js": ("import * as _ from 'lodash'", ("lodash", "namespace", "_", [])), "b.js": ("import {a, b as c} from \"X\"", ("x", "named", "", [("a", "a"), ("b", "c")])), "c.py": ("from a.b import c as d, e", ("a.b", "from", "", [("c", "d"), ("e", "e")])),
        "d.go": ('import "a/b/c"', ("a/b/c", "go", "c", [])), "e.java": ("import static a.b.C;", ("a.b.c", "java", "C", [])), "f.py": ("import a.b", ("a.b", "simple", "a.b", [])), "g.py": ("important x", None), "h.js": ("import 'x'", None),
    }
    got = {r.path: (r.module, r.style, r.alias, [tuple(n) for n in r.names]) for r in R.imports(spark.createDataFrame([(k, v[0]) for k, v in lines.items()], "path string, content string")).collect()}
    assert got == {k: v[1] for k, v in lines.items() if v[1]}
