"""The accepted language as a GBNF grammar, for constrained generation."""

RULES = r'''
root       ::= ws (declaration ws)*
declaration ::= import | source | contract | domain | model | test | fn | pipeline | call
import     ::= "import" sp name ("." name)*
source     ::= "source" sp name ws ("(" ws pairs? ")")? ws ("{" ws "columns" ws ":" ws "{" ws fields "}" ws "}")?
pairs      ::= pair (ws "," ws pair)* ws
pair       ::= name ws ":" ws (string | name)
contract   ::= "contract" sp name ws "{" ws fields "}"
fields     ::= (field ws ([,;] ws)?)*
field      ::= name ws ":" ws type (sp flag)*
flag       ::= "nonnull" | "unique" | "primary_key" | "protected" | "enum" ws "{" ws word (ws "," ws word)* ws "}" | "classification" ws ":" ws word
type       ::= "int64" | "float64" | "string" | "bool" | "date" | "timestamp" | "uuid" | "json" | "decimal" ("(" int "," ws int ")")? | "money" ("(" name ")")? | "array(" type ")" | "map(" type "," ws type ")" | "struct<" name ":" ws type ("," ws name ":" ws type)* ">" | name
domain     ::= "domain" sp name ws "=" ws type
model      ::= "model" sp word (ws "->" ws "contract" sp name)? ws "{" ws (member ws)* "}"
member     ::= attribute | hint | statement
attribute  ::= ("owner" | "reason" | "description" | "label" | "staleness_ok") ws ":" ws word
hint       ::= "partition_by" ws "[" ws exprs "]" | "freshness" sp duration (ws "," ws duration)* (sp "freshness_column" ws ":" ws name)? | "incremental" (sp "merge_strategy" ws ":" ws name)? (sp "merge_keys" ws ":" ws "[" ws exprs "]")? (sp "cdc_column" ws ":" ws name)?
duration   ::= name | int [hdw] | string
statement  ::= "from" sp name | join | ("filter" | "where") sp expr | "let" sp name ws "=" ws expr | ("select" | "derive") ws assigns | group | sort | take | "expand" sp name (sp "as" sp name)? | ("union" (sp "all")? | "intersect" | "except") sp name | "dedup" (sp "by" sp expr (ws "," ws expr)*)?
join       ::= ("join_left" | "join_inner" | "join_semi" | "join_anti") sp name sp "on" sp expr (sp "expect" sp ("many_to_one" | "one_to_one"))?
group      ::= "group" ws "{" ws exprs? "}" ws "(" ws (grouped ws)* ")"
grouped    ::= ("filter" | "where") sp expr | "aggregate" ws assigns | sort | take
assigns    ::= "{" ws (assign (ws "," ws assign)*)? ws ","? ws "}"
assign     ::= name ws "=" ws expr
sort       ::= "sort" ws "{" ws key (ws "," ws key)* ws "}"
key        ::= expr (sp ("asc" | "desc"))?
take       ::= "take" sp int (".." int)?
exprs      ::= expr (ws "," ws expr)* ws
expr       ::= and (sp "or" sp and)*
and        ::= compare (sp "and" sp compare)*
compare    ::= sum (ws ("==" | "!=" | "<=" | ">=" | "<" | ">") ws sum | sp ("like" | "rlike" | "in") sp sum)*
sum        ::= product (ws ("+" | "-" | "||") ws product)*
product    ::= unary (ws ("*" | "/" | "%") ws unary)*
unary      ::= ("not" sp | "-")* primary
primary    ::= number | string | "true" | "false" | "null" | "(" ws expr ws ")" | "[" ws exprs? "]" | call (sp "over" ws "(" ws window? ws ")")? | name "." name | name
call       ::= name "(" ws ("distinct" sp)? (arg (ws "," ws arg)*)? ws ")"
arg        ::= "*" | name ws ":" ws expr | expr
window     ::= clause (ws "," ws clause)?
clause     ::= "partition_by" ws ":" ws "[" ws exprs? "]" | "sort" ws ":" ws "[" ws key (ws "," ws key)* ws "]"
test       ::= "test" sp name ws "{" ws (expect ws)* "}"
expect     ::= "expect" sp name (ws ("==" | "!=" | "<=" | ">=" | "<" | ">") ws "-"? (number | string | "true" | "false") | sp "in" sp name "." name)
fn         ::= "fn" sp name "(" ws (name ws ":" ws generic (ws "," ws name ws ":" ws generic)*)? ws ")" ws "->" ws generic ws "{" ws value ws "}"
generic    ::= name ("<" generic ">")?
value      ::= "[" ws value sp "for" sp name sp "in" sp value ws "]" | model | expr
pipeline   ::= "pipeline" sp name ws "{" ws (property ws ","? ws)* "}"
property   ::= "env" ws ":" ws word | "models" ws ":" ws "[" ws exprs? "]" | "sources" ws ":" ws "{" ws (name ws ":" ws "from(" ws pairs? ")" ws ","? ws)* "}"
word       ::= string | name
name       ::= [A-Za-z_] [A-Za-z0-9_]*
string     ::= "\"" ([^"\\] | "\\" ["\\nt])* "\""
number     ::= int ("." [0-9]+)?
int        ::= [0-9] [0-9_]*
sp         ::= [ \t\n]+
ws         ::= ([ \t\n] | "//" [^\n]* "\n" | "#" [^\n]* "\n")*
'''


def gbnf() -> str:
    return RULES.strip() + "\n"


def undefined() -> set[str]:
    """Rules that are used but not defined; empty if the grammar is whole."""
    import re

    defined = set(re.findall(r"^(\w+)\s*::=", RULES, re.M))
    bodies = re.sub(r'"(?:[^"\\]|\\.)*"|\[(?:[^\]\\]|\\.)*\]', " ", re.sub(r"^\w+\s*::=", "", RULES, flags=re.M))
    return set(re.findall(r"[a-z]\w*", bodies)) - defined
