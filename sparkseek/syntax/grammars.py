"""Parsing-expression grammars of TypeScript, TSX, JavaScript, Python 3.13 and strict JSON."""

from __future__ import annotations

from functools import cache

from .lexers import JS_CONTEXTUAL, JS_RESERVED, PY_KEYWORDS, PY_SOFT, Tokens, lex_js, lex_json, lex_python
from .peg import Grammar

_IDENT = frozenset(["NAME"]) | JS_CONTEXTUAL
_ANYWORD = _IDENT | JS_RESERVED
_CLASSES = {
    "id": _IDENT,
    "word": _ANYWORD,
    "assignop": frozenset("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split()),
    "binop": frozenset("+ - * / % ** < <= << == != === !== & | ^ && || ?? in instanceof".split()),
    "unop": frozenset("! ~ + - ++ -- typeof void delete await".split()),
    "mod": frozenset("static public private protected readonly override abstract declare accessor async".split()),
    "jsmod": frozenset(["static", "async"]),
    "parammod": frozenset("public private protected readonly override".split()),
    "notname": frozenset("( = ; : ? ! } < ,".split()) | {"EOF"},
    "atom": frozenset("NUM STR REGEX this super null true false".split()),
    "typeword": frozenset("null void this true false STR NUM TFULL const".split()),
    "aftertypeargs": frozenset("( TFULL THEAD".split()),
    "inst": frozenset(") ] ; , : EOF } . ?. === == !== != && || ?? = |".split()),
}

_SHARED = """
Program <- Stmt* 'EOF'
Block <- '{' Stmt* '}'
Stmt <- Block / VarDecl / FuncDecl / ClassDecl / If / For / While / Do / Return / Jump / Throw / Try / Switch / Import / Export / TsDecl / 'debugger' SEMI / With / ';' / Label / ExprStmt
VarDecl <- ('var' / 'const' !'enum' / 'let' &(<id> / '[' / '{')) Binding (',' Binding)* SEMI
Binding <- Target Definite? TypeAnn? ('=' Assign)?
Target <- <id> / ArrPat / ObjPat
ArrPat <- '[' ','* (PatEl (','+ PatEl)* ','*)? ']'
PatEl <- '...' Target / Target ('=' Assign)?
ObjPat <- '{' (PatProp (',' PatProp)* ','?)? '}'
PatProp <- '...' Target / PropName ':' Target ('=' Assign)? / <id> ('=' Assign)?
FuncDecl <- ('async' NONLNEXT)? 'function' '*'? <id> TypeParams? Params RetType? FuncBody
NONLNEXT <- NONL
Params <- '(' (Param (',' Param)* ','?)? ')'
Param <- Decorator* ParamMod* '...'? ParamTarget Optional? TypeAnn? ('=' Assign)?
ClassDecl <- Decorator* AbstractMod? 'class' ClassTail
ClassTail <- (!'extends' !'implements' <id>)? TypeParams? ('extends' Lhs TypeArgs?)? Implements? '{' Member* '}'
Member <- ';' / 'static' Block / Decorator* Modifier* (Accessor / IndexSig / MethodOrField)
Accessor <- ('get' / 'set') !<notname> MemberName Params RetType? MethodBody
MethodOrField <- '*'? MemberName (Optional / Definite)? (TypeParams? Params RetType? MethodBody / TypeAnn? ('=' Assign)? SEMI)
MemberName <- PropName / 'PRIVATE'
PropName <- <word> / 'STR' / 'NUM' / '[' Assign ']'
Decorator <- '@' (<id> / '(' Expr ')') ('.' <word>)* TypeArgs? Args?
If <- 'if' '(' Expr ')' Stmt ('else' Stmt)?
For <- 'for' 'await'? '(' (ForIn / ForOf / ForHead) ')' Stmt
ForIn <- (('var' / 'let' / 'const') Target / Lhs) 'in' Expr
ForOf <- (('var' / 'let' / 'const') Target / !'let' Lhs) 'of' Assign
ForHead <- (('var' / 'let' / 'const') Binding (',' Binding)* / Expr)? ';' Expr? ';' Expr?
While <- 'while' '(' Expr ')' Stmt
Do <- 'do' Stmt 'while' '(' Expr ')' ';'?
Return <- 'return' (NONL !';' !'}' !'EOF' Expr)? SEMI
Jump <- ('break' / 'continue') (NONL <id>)? SEMI
Throw <- 'throw' NONL Expr SEMI
Try <- 'try' Block (Catch Finally? / Finally)
Catch <- 'catch' ('(' Target TypeAnn? ')')? Block
Finally <- 'finally' Block
Switch <- 'switch' '(' Expr ')' '{' ('case' Expr ':' Stmt* / 'default' ':' Stmt*)* '}'
With <- 'with' '(' Expr ')' Stmt
Label <- <id> ':' Stmt
ExprStmt <- !'{' !'function' !'class' Expr SEMI
Import <- 'import' (ImportFrom / 'STR' ImportAttr? / ImportEquals) SEMI / &'import' ExprStmt
ImportFrom <- TypeOnly? ImportClause 'from' 'STR' ImportAttr?
ImportClause <- <id> (',' (NameSpaceImport / ImportNames))? / NameSpaceImport / ImportNames
NameSpaceImport <- '*' 'as' <id>
ImportNames <- '{' (ImportName (',' ImportName)* ','?)? '}'
ImportName <- TypeOnlyName? (<word> / 'STR') 'as' <id> / TypeOnlyName? <id>
ImportAttr <- ('with' / 'assert') '{' ((<word> / 'STR') ':' 'STR' (',' (<word> / 'STR') ':' 'STR')* ','?)? '}'
Export <- Decorator* 'export' ExportTail
ExportTail <- 'default' ExportDefault / TypeOnly? '*' ('as' (<word> / 'STR'))? 'from' 'STR' ImportAttr? SEMI / TypeOnly? ExportNames ('from' 'STR' ImportAttr?)? SEMI / ExportTs / VarDecl / FuncDecl / ClassDecl / TsDecl
ExportDefault <- AnonFunc / ClassDecl / DefaultTs / !'function' !'class' Assign SEMI
AnonFunc <- 'async'? 'function' '*'? <id>? TypeParams? Params RetType? FuncBody
ExportNames <- '{' (ExportName (',' ExportName)* ','?)? '}'
ExportName <- TypeOnlyName? (<word> / 'STR') ('as' (<word> / 'STR'))?
Expr <- Assign (',' Assign)*
Assign := Arrow / Yield / Cond (<assignop> Assign)?
Yield <- 'yield' (NONL '*'? Assign)?
Arrow <- (('async' NONL)? <id> NONL / ('async' NONL)? ARROW Params RetType? NONL / GenericArrow) '=>' ArrowBody
ArrowBody <- Block / !'{' Assign
Cond <- Binary ('?' Assign ':' Assign)?
Binary <- (Unary / 'PRIVATE' &'in') (BinOp Unary / Cast)*
BinOp <- <binop> / '>' '>'? '>'? '='?
Unary <- <unop> Unary / TypeAssertion / Lhs (NONL ('++' / '--'))?
Lhs := (New / Primary) Suffix*
New <- 'new' ('.' 'target' / (New / Primary) MemberSuffix* CallTypeArgs? Args?)
MemberSuffix <- '.' (<word> / 'PRIVATE') / '[' Expr ']' / NonNull / Template
Suffix <- '.' (<word> / 'PRIVATE') / Args / '[' Expr ']' / '?.' (Args / '[' Expr ']' / <word> / 'PRIVATE' / TypeArgs Args) / Template / NonNull / CallTypeArgs
Args <- '(' (Arg (',' Arg)* ','?)? ')'
Arg <- '...'? Assign
Template <- 'TFULL' / 'THEAD' Expr ('TMID' Expr)* 'TTAIL'
Primary <- FuncExpr / <id> / <atom> / Template / '(' Expr ')' / Array / Object / 'class' ClassTail / Decorator+ 'class' ClassTail / ImportExpr / Jsx
FuncExpr <- ('async' NONL)? 'function' '*'? <id>? TypeParams? Params RetType? Block
ImportExpr <- 'import' ('(' Assign (',' Assign)? ','? ')' / '.' 'meta')
Array <- '[' ','* (Arg (','+ Arg)* ','*)? ']'
Object <- '{' (Prop (',' Prop)* ','?)? '}'
Prop <- '...' Assign / (('get' / 'set') !<notname> PropName Params RetType? Block) / ('async' !<notname>)? '*'? PropName TypeParams? Params RetType? Block / PropName ':' Assign / <id> ('=' Assign)?
"""

_NO_TS = """
Definite <- FAIL
TypeAnn <- FAIL
RetType <- FAIL
TypeParams <- FAIL
TypeArgs <- FAIL
CallTypeArgs <- FAIL
GenericArrow <- FAIL
Optional <- FAIL
ParamMod <- FAIL
ParamTarget <- Target
AbstractMod <- FAIL
Implements <- FAIL
Modifier <- <jsmod> !<notname>
IndexSig <- FAIL
FuncBody <- Block
MethodBody <- Block
TsDecl <- FAIL
ExportTs <- FAIL
DefaultTs <- FAIL
TypeOnly <- FAIL
TypeOnlyName <- FAIL
ImportEquals <- FAIL
Cast <- FAIL
TypeAssertion <- FAIL
NonNull <- FAIL
"""

_TS = """
Definite <- '!' &':'
TypeAnn <- ':' Type
RetType <- ':' (Predicate / Type)
Predicate <- 'asserts' NONL (<id> / 'this') ('is' Type)? / (<id> / 'this') NONL 'is' Type
TypeParams <- '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam <- ('const' / 'in' / 'out')* <id> ('extends' Type)? ('=' Type)?
TypeArgs := '<' Type (',' Type)* '>'
CallTypeArgs <- TypeArgs (&<aftertypeargs> / &<inst> / NL)
Optional <- '?'
ParamMod <- <parammod> &(<id> / '{' / '[')
ParamTarget <- Target / 'this'
AbstractMod <- 'abstract'
Implements <- 'implements' Type (',' Type)*
Modifier <- <mod> !<notname>
IndexSig <- '[' <id> ':' Type ']' TypeAnn SEMI
FuncBody <- Block / SEMI
MethodBody <- Block / SEMI
TsDecl <- Interface / TypeAlias / Enum / Namespace / Declare / 'abstract' NONL ClassDecl
Interface <- 'interface' NONL <id> TypeParams? ('extends' Type (',' Type)*)? ObjType
TypeAlias <- 'type' NONL <id> TypeParams? '=' Type SEMI
Enum <- 'const'? 'enum' <id> '{' (EnumMember (',' EnumMember)* ','?)? '}'
EnumMember <- PropName ('=' Assign)?
Namespace <- ('namespace' / 'module') NONL (<id> ('.' <id>)* / 'STR') (Block / SEMI) / 'global' Block
Declare <- 'declare' NONL (VarDecl / FuncDecl / ClassDecl / TsDecl)
ExportTs <- '=' Expr SEMI / 'as' 'namespace' <id> SEMI / 'import' ImportEquals SEMI
DefaultTs <- Interface / 'abstract' ClassDecl
TypeOnly <- 'type' &('{' / '*' / <id> !'=' ) !('from' 'STR')
TypeOnlyName <- 'type' !',' !'}' !('as' <id> (',' / '}'))
ImportEquals <- TypeOnly? <id> '=' ('require' '(' 'STR' ')' / <id> ('.' <id>)*)
Cast <- NONL ('as' / 'satisfies') Type
NonNull <- NONL '!'
Type := FuncType / Union ('extends' NONL Union '?' Type ':' Type)?
FuncType <- ('abstract'? 'new')? TypeParams? ARROW Params '=>' (Predicate / Type) / ('abstract'? 'new')? TypeParams Params '=>' (Predicate / Type)
Union <- ('|' / '&')? TypeOp (('|' / '&') (FuncType / TypeOp))*
TypeOp <- ('keyof' / 'unique' / 'readonly') !<aftertypename> TypeOp / 'infer' <id> ('extends' Type !'?')? / Postfix
Postfix <- PrimType (NONL '[' Type? ']')*
PrimType <- '(' Type ')' / ObjType / Tuple / <typeword> / '-' 'NUM' / 'THEAD' Type ('TMID' Type)* 'TTAIL' / 'typeof' ('import' '(' 'STR' ')' / <id> / 'this') ('.' <word>)* (NONL TypeArgs)? / 'import' '(' 'STR' ')' ('.' <word>)* TypeArgs? / <id> ('.' <word>)* (NONL TypeArgs)?
Tuple <- '[' (TupleEl (',' TupleEl)* ','?)? ']'
TupleEl <- '...'? (<word> '?'? ':' Type / Type '?'?)
ObjType <- '{' (Mapped / TypeMember*) '}'
Mapped <- (('+' / '-')? 'readonly')? '[' <id> 'in' Type ('as' Type)? ']' (('+' / '-')? '?')? TypeAnn? (';' / ',')?
TypeMember <- (Call / Index / Get / PropSig) (';' / ',' / &'}' / NL)
Call <- 'new'? TypeParams? Params RetType?
Index <- ('readonly' / 'static')? '[' <id> ':' Type ']' '?'? TypeAnn
Get <- ('get' / 'set') !<notname> PropName Params RetType?
PropSig <- ('readonly' !<notname>)? PropName '?'? (TypeParams? Params RetType? / TypeAnn?)
"""

_PLAIN_TS = """
TypeAssertion <- '<' Type '>' Unary
GenericArrow <- ('async' NONL)? TypeParams Params RetType? NONL
Jsx <- FAIL
"""
_TSX = """
TypeAssertion <- FAIL
GenericArrow <- ('async' NONL)? TypeParams Params RetType? NONL
Jsx <- 'J<' (JName TypeArgs? JAttr*)? ('J/' 'J>' / 'J>' JChild* 'J<' 'J/' JName? 'J>')
JName <- 'JNAME' ('J:' 'JNAME' / ('J.' 'JNAME')*)
JAttr <- '{' '...' Assign '}' / 'JNAME' ('J:' 'JNAME')? ('J=' ('JSTR' / '{' Assign '}' / Jsx))?
JChild <- 'JTEXT' / '{' ('...'? Expr)? '}' / JsxChild
JsxChild <- !('J<' 'J/') Jsx
"""

_JSON_RULES = """
Doc <- Value 'EOF'
Value <- 'STR' / 'NUM' / 'WORD' / '{' (Pair (',' Pair)*)? '}' / '[' (Value (',' Value)*)? ']'
Pair <- 'STR' ':' Value
"""

_PY_CLASSES = {
    "id": frozenset(["NAME"]) | PY_SOFT,
    "aug": frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split()),
    "cmp": frozenset("== != < <= > >=".split()),
    "ar": frozenset("| ^ & << >> + - * / // % @".split()),
    "const": frozenset("NUM None True False ...".split()),
}
_PYTHON_RULES = """
File <- Stmt* 'EOF'
Stmt <- Compound / Simples
Simples <- Simple (';' Simple)* ';'? 'NEWLINE'
Simple <- 'return' StarExprs? / 'pass' / 'break' / 'continue' / 'raise' (Test ('from' Test)?)? / 'global' <id> (',' <id>)* / 'nonlocal' <id> (',' <id>)* / 'del' DelTargets / 'assert' Test (',' Test)? / ImportStmt / TypeStmt / Assignment / StarExprs
ImportStmt <- 'import' Dotted ('as' <id>)? (',' Dotted ('as' <id>)?)* / 'from' ('.' / '...')* Dotted? 'import' ('*' / '(' AsName (',' AsName)* ','? ')' / AsName (',' AsName)*)
Dotted <- <id> ('.' <id>)*
AsName <- <id> ('as' <id>)?
TypeStmt <- 'type' <id> TParams? '=' Test
Assignment <- AnnTarget ':' Test ('=' (Yield / StarExprs))? / (Targets '=')+ (Yield / StarExprs) !'=' / AugTarget <aug> (Yield / StarExprs)
AnnTarget <- '(' AugTarget ')' / AugTarget
AugTarget <- <id> !Trailer / Attr
Targets <- Target (',' Target)* ','?
Target <- '*'? (Attr / <id> !Trailer / '(' Targets? ')' !Trailer / '[' Targets? ']' !Trailer)
Attr := Atom (Trailer &Trailer)* ('.' <id> / '[' Slices ']') !Trailer
DelTargets <- DelTarget (',' DelTarget)* ','?
DelTarget <- Attr / <id> !Trailer / '(' DelTargets? ')' / '[' DelTargets? ']'
Block <- 'NEWLINE' 'INDENT' Stmt+ 'DEDENT' / Simples
Compound <- If / While / For / Try / With / Def / Class / AsyncStmt / Match
If <- 'if' Named ':' Block ('elif' Named ':' Block)* ('else' ':' Block)?
While <- 'while' Named ':' Block ('else' ':' Block)?
For <- 'for' Targets 'in' StarExprs ':' Block ('else' ':' Block)?
Try <- 'try' ':' Block (Except+ ('else' ':' Block)? ('finally' ':' Block)? / 'finally' ':' Block)
Except <- 'except' '*'? (Test ('as' <id>)?)? ':' Block
With <- 'with' ('(' WithItem (',' WithItem)* ','? ')' ':' / WithItem (',' WithItem)* ':') Block
WithItem <- Test ('as' Target)?
AsyncStmt <- 'async' (Def / For / With)
Def <- Decorators? 'async'? 'def' <id> TParams? '(' PyParams? ')' ('->' Test)? ':' Block
Decorators <- ('@' Named 'NEWLINE')+
Class <- Decorators? 'class' <id> TParams? ('(' CallArgs? ')')? ':' Block
TParams <- '[' TParam (',' TParam)* ','? ']'
TParam <- ('*' / '**')? <id> (':' Test)? ('=' Test)?
PyParams <- PlainParams
PlainParams <- (PosPart (',' '/' (',' PosMore)? / ',' StarPart)? / StarPart) ','?
PosPart <- PParam (',' PParam)* 
PosMore <- PosPart (',' StarPart)? / StarPart
StarPart <- '*' PName (',' PParam)* (',' KwPart)? / '*' (',' PParam)+ (',' KwPart)? / KwPart
KwPart <- '**' PName
PName <- <id> (':' ('*' Or / Test))?
PParam <- PName ('=' Test)?
LParams <- (LPos (',' '/' (',' LMore)? / ',' LStar)? / LStar) ','?
LPos <- LParam (',' LParam)*
LMore <- LPos (',' LStar)? / LStar
LStar <- '*' <id> (',' LParam)* (',' '**' <id>)? / '*' (',' LParam)+ (',' '**' <id>)? / '**' <id>
LParam <- <id> ('=' Test)?
Match <- 'match' StarNamed ':' 'NEWLINE' 'INDENT' Case+ 'DEDENT'
Case <- 'case' Patterns ('if' Named)? ':' Block
Patterns <- Pattern (',' Pattern)* ','?
Pattern <- '*' <id> / OrPat ('as' <id>)?
OrPat <- ClosedPat ('|' ClosedPat)*
ClosedPat <- 'STR'+ / '-'? 'NUM' (('+' / '-') 'NUM')? / 'None' / 'True' / 'False' / '(' Patterns? ')' / '[' Patterns? ']' / '{' (MapPat (',' MapPat)* ','?)? '}' / <id> ('.' <id>)* ('(' (ArgPat (',' ArgPat)* ','?)? ')')?
MapPat <- '**' <id> / ('STR'+ / '-'? 'NUM' / 'None' / 'True' / 'False' / <id> ('.' <id>)+) ':' Pattern
ArgPat <- <id> '=' Pattern / Pattern
StarExprs <- StarExpr (',' StarExpr)* ','? / Yield
StarExpr <- '*' Or / Test
StarNamed <- ('*' Or / Named) (',' ('*' Or / Named))* ','?
Yield <- 'yield' ('from' Test / StarExprs)?
Named <- <id> ':=' Test / Test
Test := Lambda / Disj ('if' Disj 'else' Test)?
Lambda <- 'lambda' LParams? ':' Test
Disj <- Conj ('or' Conj)*
Conj <- Not ('and' Not)*
Not <- 'not' Not / Or ((<cmp> / 'in' / 'not' 'in' / 'is' 'not'?) Or)*
Or <- Un (<ar> Un)*
Un <- ('+' / '-' / '~') Un / Await ('**' Un)?
Await <- 'await'? Prim
Prim := Atom Trailer*
Trailer <- '.' <id> / '(' CallArgs? ')' / '[' Slices ']'
CallArgs <- Argument (',' Argument)* ','?
Argument <- '*' Test / '**' Test / <id> '=' Test / Named Comp?
Slices <- Slice (',' Slice)* ','?
Slice <- '*' Or / Test? ':' Test? (':' Test?)? / Named
Atom <- <id> / <const> / 'STR'+ / '(' (Yield / StarNamed Comp?)? ')' / '[' (StarNamed Comp?)? ']' / '{' (Dict / StarNamed Comp?)? '}'
Dict <- DItem (Comp / (',' DItem)* ','?)
DItem <- '**' Or / Test ':' Test
Comp <- ('async'? 'for' Targets 'in' Disj ('if' Named2)*)+
Named2 <- Disj
"""


@cache
def grammar(language: str) -> Grammar:
    """The compiled grammar of `ts`, `tsx`, `js`, `python` or `json`."""
    if language == "json":
        return Grammar(_JSON_RULES, {}, "Doc")
    if language == "python":
        return Grammar(_PYTHON_RULES, _PY_CLASSES, "File")
    rules = {
        "js": _SHARED + _NO_TS + "Jsx <- FAIL\n",
        "ts": _SHARED + _TS + _PLAIN_TS,
        "tsx": _SHARED + _TS + _TSX,
    }[language]
    classes = _CLASSES | {"aftertypename": frozenset("; , ) ] } = > | & ? [ .".split()) | {"EOF"}}
    if language == "js":
        classes = classes | {"id": _IDENT}
    return Grammar(rules, classes, "Program")


# Language by extension.
LANGUAGES = {".ts": "ts", ".tsx": "tsx", ".js": "js", ".cjs": "js", ".py": "python", ".json": "json"}


def lex(language: str, text: str) -> Tokens:
    if language == "json":
        return lex_json(text)
    if language == "python":
        return lex_python(text)
    return lex_js(text, language == "tsx")


def furthest_failure(language: str, text: str) -> tuple[Tokens, int]:
    """The tokens and -1 if the whole text is valid, else the furthest token at which reading failed."""
    tokens = lex(language, text)
    if "ERR" in tokens.kind:
        first = tokens.kind.index("ERR")
        far = grammar(language).parse(tokens.kind, tokens.newline, tokens.match)
        return tokens, first if far < 0 else min(far, first)
    return tokens, grammar(language).parse(tokens.kind, tokens.newline, tokens.match)
