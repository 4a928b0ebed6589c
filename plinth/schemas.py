"""Schemas of the code relations."""

METRICS = "struct<cyclomatic:int,maintainability_index:double,risk_flag:boolean>"
DEFINITION = (
    "struct<name:string,category:string,start_line:int,end_line:int,line_count:int,is_async:boolean,decorators:array<string>,docstring:string,"
    f"outbound_calls:array<string>,parents:array<string>,source_text:string,source_hash:string,has_type_hints:boolean,metrics:{METRICS}>"
)
FILES = (
    "path string, imports array<string>, stdlib_imports array<string>, declared_variables array<string>, comprehension_patterns map<string,int>, "
    "loop_count int, branch_count int, exception_blocks int, exception_raises int, regex_patterns int, generator_count int, comment_count int, uses_async boolean, "
    f"oop_patterns map<string,boolean>, concurrent_libs array<string>, module_docstring string, definitions array<{DEFINITION}>, metrics {METRICS}, parse_error string"
)
BLOCKS = "path string, ordinal int, start_line int, end_line int, content string, hash string, normalized string, embedding array<double>, embedding_normalized array<double>"
VARIABLES = "path string, is_definition boolean, name string, line_number int, scope string, kind string, type_hint string, value_source string"
SOURCES = "path string, full_path string, content string"
COMMITS = "ord int, hash string, short_hash string, timestamp timestamp, author string, author_email string, message string, files_changed array<string>, insertions int, deletions int"
SNAPSHOT_FILES = "commit string, path string, blob string"
