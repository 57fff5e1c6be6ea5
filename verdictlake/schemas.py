"""Schemas of the experiment records."""

SPAN = "struct<file: string, start_byte: bigint, end_byte: bigint, start_line: bigint, start_column: bigint, end_line: bigint, end_column: bigint>"
MUTATION = f"struct<id: string, operator: string, rule_id: string, span: {SPAN}, original: string, replacement: string, description: string, suggestion: string, diff: string, equivalent_reason: string>"
DIAGNOSTIC = f"struct<id: string, location: {SPAN}, statement: string, evidence: string, assumptions: array<string>, suggestion: string>"
RESULT = (
    f"struct<mutation: {MUTATION}, verdict: string, responsible_tests: array<string>, responsible_assertions: array<struct<test: string, file: string, line: bigint, message: string>>, "
    "responsible_panics: array<struct<test: string, message: string>>, covered_by_selected_tests: boolean, coverage_known: boolean, cached: boolean, duration_ms: bigint, output: string, "
    f"output_truncated: boolean, diagnostic: {DIAGNOSTIC}>"
)
SUMMARY = "struct<generated: bigint, killed: bigint, survived: bigint, invalid: bigint, timeout: bigint, unknown: bigint, unsupported: bigint, equivalent: bigint, score: double, score_text: string>"
TIMING = "struct<parsing_ms: bigint, baseline_ms: bigint, execution_ms: bigint, rendering_ms: bigint, total_ms: bigint>"
REPORT = (
    "struct<schema_version: string, tool_version: string, go_version: string, generated_at: timestamp, complete: boolean, patterns: array<string>, effective_config: string, bounds: string, "
    f"semantics: array<string>, warnings: array<string>, summary: {SUMMARY}, results: array<{RESULT}>, timing: {TIMING}>"
)
HISTORY = (
    "time timestamp, label string, score double, score_text string, generated bigint, killed bigint, survived bigint, invalid bigint, timeout bigint, unknown bigint, unsupported bigint, equivalent bigint, "
    "complete boolean, discovered_before_bound bigint, retained_after_bound bigint, completed_mutants bigint, patterns array<string>, test_working_directory string, operator_semantics string, "
    "operators string, test_run string, coverage_test_selection string, narrow_test_scope string"
)
TEST_EVENT = "Action string, Package string, Test string, Output string, Elapsed double"
PACKAGE = "struct<Dir: string, GoFiles: array<string>, CgoFiles: array<string>, TestGoFiles: array<string>, XTestGoFiles: array<string>, ImportPath: string, Deps: array<string>, ForTest: string, Error: struct<Err: string>>"
