"""Literal outputs, one for each rule, with what must stay and what must go."""

import pytest

from txcompact.operators.rules import classify, compact_blocks

N = "\n"
DIFF = "diff --git a/src/foo.ts b/src/foo.ts\n--- a/src/foo.ts\n+++ b/src/foo.ts\n@@ -1,5 +1,5 @@ fn\n ctx one\n even more context\n-old\n+new\n after\n even more context too"
CASES = [
    ("bash", "gitDiff", DIFF, ["-old", "+new", "ctx one"], ["even more context too"]),
    ("bash", "gitLog", N.join(f"abc{i:04d} commit number {i}" for i in range(45)), ["commit number 29", "[15 more commits]"], ["commit number 30"]),
    ("bash", "gitLog", "commit 0123456789abcdef\nAuthor: Ann <a@b.c>\nDate:   Mon\n\n    first message\n\ncommit fedcba9876543210\nAuthor: Bob <b@b.c>\nDate:   Tue\n\n    second message", ["0123456 first message (Ann, Mon)", "fedcba9 second message (Bob, Tue)"], ["Author"]),
    ("bash", "gitStatus", "On branch main\nYour branch is ahead of 'origin/main' by 1 commit.\n\nChanges not staged for commit:\n  (use git add)\n\tmodified:   src/first_file.ts\n\tmodified:   src/second_file.ts\n\nUntracked files:\n\tnew_file_name.txt\n", ["* main", "~ Modified: 2 files", "? Untracked: 1 file", "new_file_name.txt"], ["use git add"]),
    ("bash", "gitBranch", N.join([f"  feature/branch-{i}" for i in range(30)] + ["* main-line"]), ["* main-line", "[15 more branches]"], ["branch-20"]),
    ("bash", "cargoTest", "running 2 tests\ntest alpha_test ... ok\ntest beta_test ... FAILED\n\ntest result: FAILED. 1 passed; 1 failed", ["beta_test ... FAILED", "test result"], ["alpha_test"]),
    ("bash", "cargoTest", "running 2 tests\ntest alpha_test ... ok\ntest beta_test ... ok\ntest result: ok. 2 passed", ["test result: ok"], ["alpha_test"]),
    ("bash", "cargoBuild", "   Compiling foo v0.1.0\nerror[E0308]: mismatched types\n  --> src/main.rs:4:5\nerror: aborting due to previous error", ["E0308", "main.rs", "aborting"], ["Compiling"]),
    ("bash", "vitest", "✓ passing suite one (3)\n✓ passing suite two (3)\n× failing case name\nAssertionError: expected 1 to be 2\nTest Files  1 failed | 2 passed\nDuration  1.2s", ["failing case name", "AssertionError", "Test Files"], ["passing suite one"]),
    ("bash", "playwright", "Running 5 tests using playwright\n  ✓ passes.spec.ts one\n  ✘ broken.spec.ts two\n    expect(received).toBe\n  ✓ passes.spec.ts three\n  1 failed\n  4 passed", ["broken.spec.ts", "toBe", "1 failed", "4 passed"], ["passes.spec.ts"]),
    ("bash", "pyTraceback", "collected stuff line\nTraceback (most recent call last):\n  File \"a.py\", line 1\nValueError: wrong value\nafter the error", ["Traceback", "a.py", "ValueError"], ["collected", "after the error"]),
    ("bash", "goTest", "--- PASS: TestOne (0.00s)\n--- FAIL: TestTwo (0.00s)\n    file_test.go:10: wrong\nFAIL\tpkg/example\t0.01s\n--- PASS: TestThree (0.00s)", ["TestTwo", "file_test.go", "pkg/example"], ["TestOne", "TestThree"]),
    ("bash", "tsc", "src/foo.ts(1,2): error TS2345: bad one\nsrc/bar.ts(1,2): error TS2345: bad two\nsrc/foo.ts(3,2): error TS2322: bad three", ["src/foo.ts: 2 error(s)", "src/bar.ts: 1 error(s)"], []),
    ("bash", "eslint", "/home/me/file.js\n  1:10  error  Missing semicolon  https://eslint.org/rules/semi\n  2:10  warning  Unused\nchatter of some kind\n2 problems", ["Missing semicolon", "2 problems"], ["https://", "chatter"]),
    ("bash", "prettier", "Checking formatting now\n[warn] src/index.ts\n[warn] Code style issues found", ["src/index.ts", "Code style"], ["Checking"]),
    ("bash", "nextBuild", "Next.js 14.0.0\nCreating an optimized build\nRoute (app)  Size\n○ /index  5 kB\n+ First Load JS shared 80 kB", ["Route (app)", "/index", "First Load"], ["optimized"]),
    ("bash", "pkgInstall", N.join([f"http fetch GET 200 number {i}" for i in range(50)] + ["added 120 packages in 3s", "found 0 vulnerabilities"]), ["added 120", "vulnerabilities"], ["fetch GET"]),
    ("bash", "pkgList", "project@1.0.0\n├── direct-one@1.0.0\n│   ├── nested-one@2.0.0\n│   └── nested-two@2.0.0\n└── direct-two@1.0.0", ["direct-one", "direct-two", "[2 nested packages omitted]"], ["nested-one"]),
    ("bash", "pkgOutdated", N.join(["Package  Current  Wanted  Latest"] + [f"package-{i}  1.0.{i}  1.1.{i}  2.0.{i}" for i in range(50)]), ["Package", "package-28 ", "[21 more outdated packages]"], ["package-40 "]),
    ("bash", "terraform", "Terraform will perform the following actions:\n  # aws_thing.one will be created\n    name = \"secret-attribute\"\nPlan: 1 to add, 0 to change", ["will be created", "Plan:"], ["secret-attribute"]),
    ("bash", "npx", "npm warn deprecated old-thing@1.0.0: gone\nreal output of the command", ["real output"], ["old-thing"]),
    ("bash", "dockerPs", f"CONTAINER ID   IMAGE    NAMES\n{'a1' * 32} nginx:latest  web-server\n{'b2' * 32} redis:latest  cache-server", ["CONTAINER ID", "a1" * 6 + "  nginx"], ["a1" * 7]),
    ("bash", "dockerImages", "REPOSITORY   TAG   IMAGE ID\nnginx  latest  abc123def\n<none>  <none>  deadbeef00", ["nginx"], ["deadbeef"]),
    ("bash", "kubectl", "NAME        READY     STATUS\npod-number-one      1/1       Running\npod-number-two      1/1       Running", ["pod-number-one  1/1  Running"], ["    "]),
    ("bash", "prisma", "Prisma schema loaded here\n┌──────────┐\n│ Update available text │\n└──────────┘\nGenerated client ok", ["Prisma schema", "Generated"], ["Update available"]),
    ("bash", "ghPrChecks", N.join(["NAME  STATUS  CONCLUSION"] + [f"check-number-{i}  completed  success" for i in range(40)]), ["check-number-23", "[16 more checks]"], ["check-number-30"]),
    ("bash", "ghPr", "title: Fix the thing\nstate: OPEN\nurl: https://github.com/o/r/pull/1\nA long body paragraph that says much.", ["title", "state", "url"], ["long body"]),
    ("bash", "ghRunList", N.join(["STATUS  CONCLUSION  WORKFLOW"] + [f"completed  success  workflow-{i}" for i in range(30)]), ["workflow-18", "[11 more]"], ["workflow-25"]),
    ("bash", "ghIssueList", N.join(["ISSUE  TITLE  STATE"] + [f"number-{i}  title-{i}  OPEN" for i in range(40)]), ["title-23 ", "[16 more]"], ["title-30 "]),
    ("bash", "curl", "  % Total of things\nTrying host now\nport eighty\n* Connected to host port 80\n> GET / HTTP/1.1\n> Host: example\n> Accept: all\n* closing connection\n> User-Agent: curl\n{\"result\": \"value\"}", ["result"], ["> GET", "closing"]),
    ("bash", "wget", "--2024-- http://x\nResolving example.com... 1.2.3.4\nConnecting to example.com\n2024-01-01 saved [100/100]", ["saved ["], ["Resolving"]),
    ("bash", "errorExtracted", N.join(f"ordinary line number {i}" if i != 25 else "Error: something broke" for i in range(52)), ["Error: something", "number 24", "number 26", "[49 non-error lines omitted]"], ["number 10"]),
    ("bash", "truncated", N.join(f"plain line number {i}" for i in range(100)), ["plain line number 99", "[50 earlier lines omitted]"], ["plain line number 49\n"]),
    ("bash", "truncated", N.join(f"plain line number {i}" for i in range(50)), ["plain line number 0", "plain line number 49"], ["omitted"]),
    ("grep", "grepCompacted", N.join(f"src/file_{i % 2}.ts:{i}:match number {i}" for i in range(30)), ["src/file_0.ts (15 matches):", "(+more)"], ["match number 28"]),
    ("grep", "grepCompacted", N.join(f"src/file_{i}.ts:{i}:match number {i}" for i in range(40)), ["src/file_29.ts", "[10 more files]"], ["src/file_30.ts"]),
    ("glob", "globCompacted", N.join(f"src/components/file_{i}.ts" for i in range(50)), ["50 files total", "src/components/ (50 files)"], ["file_10"]),
    ("read", "readHeadTail", N.join(f"line {i} of the file" for i in range(500)), ["line 99 of", "line 420 of", "[320 lines omitted]"], ["line 150 of"]),
    ("read", "readLockfile", N.join(f'package-{i}@1: "resolved" {i}' for i in range(300)), ["lockfile", "300 packages"], ["package-7@"]),
    ("read", "readSemantic", N.join(["import x from 'y'", "export function one() {"] + [f"  body line number {i}" for i in range(600)] + ["}"]), ["import x", "export function one", "implementation lines omitted"], ["body line number 5"]),
    ("other", None, "just some text here", ["just some text here"], []),
]


def test_rules(spark):
    rows = [(str(i), tool, text) for i, (tool, _, text, _, _) in enumerate(CASES)]
    got = {int(r.block_id): r for r in compact_blocks(spark.createDataFrame(rows, "block_id string, tool string, text string")).collect()}
    wrong = []
    for i, (_, pattern, text, stay, go) in enumerate(CASES):
        r = got[i]
        if r.pattern != pattern or any(s not in r.text for s in stay) or any(g in r.text for g in go) or r.original_chars != len(text) or r.compact_chars != len(r.text):
            wrong.append((pattern, r.pattern, [s for s in stay if s not in r.text], [g for g in go if g in r.text], r.text[:300]))
    assert len(got) == len(CASES) and not wrong, wrong


@pytest.mark.parametrize("text, pattern", [("hello", "truncated"), ("error TS1:", "tsc")])
def test_order_of_the_cascade(spark, text, pattern):
    assert classify(spark.createDataFrame([("bash", text)], "tool string, text string")).first().pattern == pattern
