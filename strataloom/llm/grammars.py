"""Grammars of the supported languages in the notation of ``gll``.

They describe syntax alone and decide validity, so operators need no precedence: an expression is operands with
operators between. Rules in two kinds of surroundings (inside functions, in control clauses) are written once and
expanded by text (``@``).
"""

from __future__ import annotations

JSON = """
Json = Value ;
Value = STR | NUM | 'true' | 'false' | 'null' | '{' sep(Member, ',')? '}' | '[' sep(Value, ',')? ']' ;
Member = STR ':' Value ;
"""

TOML = """
Toml = ((Pair | Table)? NL)* ;
Key = sep(KEY, '.') ;
Pair = Key '=' Value ;
Table = '[' Key ']' | '[[' Key ']]' ;
Value = VAL | '[' (sep(Value, ',') ','?)? ']' | '{' sep(Pair, ',')? '}' ;
"""

PYTHON = """
%class Id = ID 'match' 'case' 'type' '_' ;
Python = (NEWLINE | Stmt)* ;
Stmt = Simple | Compound ;
Simple = sep(Small, ';') ';'? NEWLINE ;
Small = ExprStmt | 'pass' | 'break' | 'continue' | 'return' Exprs? | 'raise' (Expr ('from' Expr)?)? | 'global' sep(Id, ',') | 'nonlocal' sep(Id, ',')
  | 'del' sep(Post, ',') ','? | 'assert' Expr (',' Expr)? | 'import' sep(DottedAs, ',') | FromImport | 'type' Id TypeParams? '=' Expr ;
DottedAs = Dotted ('as' Id)? ;
Dotted = sep(Id, '.') ;
FromImport = 'from' (('.' | '...')+ Dotted? | Dotted) 'import' ('*' | sep(NameAs, ',') | '(' sep(NameAs, ',') ','? ')') ;
NameAs = Id ('as' Id)? ;
ExprStmt = Exprs | Yield | Targets Augmented (Exprs | Yield) | (Exprs '=')+ (Exprs | Yield) | Post ':' Expr ('=' (Exprs | Yield))? | '(' Id ')' ':' Expr ('=' Exprs)? ;
Targets = Post ;
Augmented = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '**=' | '@=' | '&=' | '|=' | '^=' | '<<=' | '>>=' ;
Yield = 'yield' ('from' Expr | Exprs)? ;
Exprs = sep(StarExpr, ',') ','? ;
StarExpr = '*' Binary | Expr ;
Named = Id ':=' Expr | Expr ;
Expr = Lambda | Or ('if' Or 'else' Expr)? ;
Or = 'not'* Unary ((BinaryOp | CompareOp) Unary | ('and' | 'or') 'not'* Unary)* ;
CompareOp = '<' | '>' | '<=' | '>=' | '==' | '!=' | 'in' | 'not' 'in' | 'is' 'not'? ;
Binary = sep(Unary, BinaryOp) ;
BinaryOp = '+' | '-' | '*' | '/' | '//' | '%' | '**' | '@' | '&' | '|' | '^' | '<<' | '>>' ;
Unary = ('+' | '-' | '~')* 'await'? Post ;
Post = Atom Suffix* ;
Suffix = '.' Id | '(' Args? ')' | '[' Slices ']' ;
Args = sep(Arg, ',') ','? | GenArg ;
Arg = Named | Id '=' Expr | '*' Expr | '**' Expr ;
GenArg = Named For+ ;
Slices = sep(Slice, ',') ','? ;
Slice = Named | '*' Expr | Expr? ':' Expr? (':' Expr?)? ;
Atom = Id | NUM | STR+ | 'True' | 'False' | 'None' | '...' | '(' (Yield | Elements | Comp)? ')' | '[' (Elements | Comp)? ']' | '{' (Elements | Comp | DictItems)? '}' ;
Elements = sep(Element, ',') ','? ;
Element = Named | '*' Binary ;
Comp = Named For+ ;
DictItems = sep(DictItem, ',') ','? | Expr ':' Expr For+ ;
DictItem = Expr ':' Expr | '**' Binary ;
For = 'async'? 'for' ForTargets 'in' Or ('if' CompIf)* ;
CompIf = Id ':=' Or | Or | Lambda ;
ForTargets = sep(ForTarget, ',') ','? ;
ForTarget = '*'? Post ;
Lambda = 'lambda' LambdaParams? ':' Expr ;
LambdaParams = sep(LambdaParam, ',') ','? ;
LambdaParam = Id ('=' Expr)? | '*' Id? | '**' Id | '/' ;
Compound = Decorator* ('async'? FunctionDef | ClassDef) | If | While | 'async'? (ForStmt | With) | Try | Match ;
Decorator = '@' Named NEWLINE ;
TypeParams = '[' sep(TypeParam, ',') ','? ']' ;
TypeParam = ('*' | '**')? Id (':' Expr)? ('=' StarExpr)? ;
FunctionDef = 'def' Id TypeParams? '(' Params? ')' ('->' Expr)? ':' Suite ;
Params = sep(Param, ',') ','? ;
Param = Id (':' Expr)? ('=' Expr)? | '*' (Id (':' StarExpr)?)? | '**' Id (':' Expr)? | '/' ;
ClassDef = 'class' Id TypeParams? ('(' Args? ')')? ':' Suite ;
Suite = Simple | NEWLINE INDENT Stmt+ DEDENT ;
If = 'if' Named ':' Suite ('elif' Named ':' Suite)* ('else' ':' Suite)? ;
While = 'while' Named ':' Suite ('else' ':' Suite)? ;
ForStmt = 'for' ForTargets 'in' Exprs ':' Suite ('else' ':' Suite)? ;
With = 'with' (sep(WithItem, ',') | '(' sep(WithItem, ',') ','? ')') ':' Suite ;
WithItem = Expr ('as' ForTarget)? ;
Try = 'try' ':' Suite (('except' '*'? (Expr (',' Expr)* ('as' Id)?)? ':' Suite)+ ('else' ':' Suite)? ('finally' ':' Suite)? | 'finally' ':' Suite) ;
Match = 'match' Exprs ':' NEWLINE INDENT ('case' Patterns ('if' Named)? ':' Suite)+ DEDENT ;
Patterns = sep(AsPattern, ',') ','? ;
AsPattern = '*' Id | sep(Pattern, '|') ('as' Id)? ;
Pattern = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | Dotted ('(' (sep(KeyPattern, ',') ','?)? ')')? | '(' Patterns? ')' | '[' Patterns? ']'
  | '{' (sep(MapPattern, ',') ','?)? '}' ;
KeyPattern = Id '=' AsPattern | AsPattern ;
MapPattern = '**' Id | ('-'? NUM | STR+ | Dotted | 'None' | 'True' | 'False') ':' AsPattern ;
"""

JAVA = """
%class Id = ID 'record' 'sealed' 'permits' 'yield' 'var' 'module' 'open' 'opens' 'exports' 'requires' 'uses' 'provides' 'to' 'with' 'transitive' ;
%class Prim = 'boolean' 'byte' 'short' 'int' 'long' 'char' 'float' 'double' ;
%class AssignOp = '=' '+=' '-=' '*=' '/=' '&=' '|=' '^=' '%=' '<<=' ;
%class Literal = NUM STR CHAR 'true' 'false' 'null' ;
CompilationUnit = (Annotation* 'package' Qual ';')? (Import | ';')* (TypeDecl | ';')* ;
ModuleUnit = (Import | ';')* Annotation* 'open'? 'module' Qual '{' Directive* '}' ;
Directive = 'requires' ('transitive' | 'static')* Qual ';' | ('exports' | 'opens') Qual ('to' sep(Qual, ','))? ';' | 'uses' Qual ';' | 'provides' Qual 'with' sep(Qual, ',') ';' ;
Qual = sep(Id, '.') ;
Import = 'import' 'static'? Qual ('.' '*')? ';' ;
Modifier = Annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | NS ;
Annotation = '@' Qual ('(' (sep(Pair, ',') | Element)? ')')? ;
Pair = Id '=' Element ;
Element = Annotation | '{' sep(Element, ',')? ','? '}' | Cond ;
TypeDecl = Modifier* TypeRest ;
TypeRest = Class | Enum | Interface | AnnotationType | Record ;
Class = 'class' Id TParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? Body ;
Interface = 'interface' Id TParams? ('extends' Types)? ('permits' Types)? Body ;
AnnotationType = '@' 'interface' Id Body ;
Record = 'record' Id TParams? '(' sep(Component, ',')? ')' ('implements' Types)? Body ;
Component = Annotation* Type ('...')? Id ;
Enum = 'enum' Id ('implements' Types)? '{' sep(Constant, ',')? ','? (';' Member*)? '}' ;
Constant = Annotation* Id Args? Body? ;
TParams = '<' sep(TParam, ',') Gt ;
TParam = Annotation* Id ('extends' sep(Type, '&'))? ;
Types = sep(Type, ',') ;
Type = Annotation* (Prim | Named) Dims ;
Dims = (Annotation* '[' ']')* ;
Named = Id TArgs? ('.' Annotation* Id TArgs?)* ;
TArgs = '<' sep(TArg, ',')? Gt ;
TArg = Type | Annotation* '?' (('extends' | 'super') Type)? ;
Gt = '>' | '>~' ;
Body = '{' Member* '}' ;
Member = ';' | 'static'? Block | Modifier* (TypeRest | TParams? ((Type | 'void') Id Method | Id Constructor) | Type sep(Variable, ',') ';' | Id Block) ;
Method = Params Dims Throws? ('default' Element)? (Block | ';') ;
Constructor = Params Throws? Block ;
Throws = 'throws' Types ;
Params = '(' sep(Param, ',')? ')' ;
Param = Modifier* Type (Annotation* '...')? (Id '.')* (Id | 'this') Dims ;
Variable = Id Dims ('=' (ArrayInit | Expr))? ;
ArrayInit = '{' sep(Init, ',')? ','? '}' ;
Init = ArrayInit | Expr ;
Block = '{' BlockStmt* '}' ;
BlockStmt = Modifier* (Class | Enum | Interface | Record) | Modifier* Type sep(Variable, ',') ';' | Stmt ;
Paren = '(' Expr ')' ;
Stmt = Block | ';' | Effect ';' | 'if' Paren Stmt ('else' Stmt)? | 'while' Paren Stmt | 'for' '(' ForControl ')' Stmt | 'do' Stmt 'while' Paren ';' | Try
  | 'switch' Paren Switch | 'synchronized' Paren Block | 'return' Expr? ';' | 'throw' Expr ';' | 'break' Id? ';' | 'continue' Id? ';' | 'yield' Expr ';'
  | 'assert' Expr (':' Expr)? ';' | Id ':' Stmt ;
ForControl = Modifier* Type Id Dims ':' Expr | (Modifier* Type sep(Variable, ',') | sep(Effect, ','))? ';' Expr? ';' sep(Effect, ',')? ;
Try = 'try' (Block (Catch+ ('finally' Block)? | 'finally' Block) | '(' sep(Resource, ';') ';'? ')' Block Catch* ('finally' Block)?) ;
Catch = 'catch' '(' Modifier* sep(Type, '|') Id ')' Block ;
Resource = Modifier* Type Id '=' Expr | Post ;
Switch = '{' Case* '}' ;
Case = Label+ BlockStmt* | (('case' sep(Cond, ',')) | 'default') '->' (Expr ';' | Block | 'throw' Expr ';') ;
Label = ('case' sep(Cond, ',') | 'default') ':' ;
Effect = ('++' | '--') Unary | New | Atom (Suffix | Args)* (Args | AssignOp Expr | '>~' '>~' '=' Expr | '>~' '>~' '>~' '=' Expr | '++' | '--') | New (Suffix | Args)* (Args | AssignOp Expr | '++' | '--') ;
Expr = Lambda | Cond (AssignOp Expr | '>~' '>~' '=' Expr | '>~' '>~' '>~' '=' Expr)? ;
Lambda = (Id | '(' (sep(Param, ',') | sep(Id, ','))? ')') '->' (Block | Expr) ;
Cond = Unary (BinOp Unary | 'instanceof' Modifier* Type Id? | '?' Expr ':' (Lambda | Unary))* ;
BinOp = '||' | '&&' | '|' | '&' | '^' | '==' | '!=' | '<' | '<=' | '>' | '>~' '=' | '<<' | '>~' '>' | '>~' '>~' '>' | '+' | '-' | '*' | '/' | '%' ;
Unary = ('+' | '-' | '++' | '--' | '!' | '~') Unary | '(' sep(Type, '&') ')' (Unary | Lambda) | Post ('++' | '--')* ;
Post = (Atom | New) (Suffix | Args)* ;
Atom = Literal | 'this' | 'super' | Id | Paren | 'switch' Paren Switch | Prim Dims ('.' 'class' | '::' 'new') | 'void' '.' 'class'
  | Named ('[' ']')+ ('.' 'class' | '::' (Id | 'new')) | Named '::' (Id | 'new') ;
Suffix = '.' (TArgs? Id | 'this' | 'class' | TArgs? 'super' | New) | '[' Expr ']' | '::' TArgs? (Id | 'new') ;
Args = '(' sep(Expr, ',')? ')' ;
New = 'new' TArgs? Annotation* (Named Args Body? | (Prim | Named) ((Annotation* '[' Expr ']')+ Dims | (Annotation* '[' ']')+ ArrayInit)) ;
"""

GO_SHARED = """
%class AssignOp = '=' '+=' '-=' '*=' '/=' '%=' '&=' '|=' '^=' '<<=' '>>=' '&^=' ;
%class BinOp = '||' '&&' '==' '!=' '<' '<=' '>' '>=' '+' '-' '|' '^' '*' '/' '%' '<<' '>>' '&' '&^' ;
%class UnOp = '+' '-' '!' '^' '*' '&' '<-' '~' ;
Go = 'package' ID ';' (Import ';')* (Top ';')* ;
Import = 'import' (ImportSpec | '(' (ImportSpec ';')* ImportSpec? ')') ;
ImportSpec = ('.' | ID)? STR ;
Top = Decl | 'func' ID TParams? Signature Block? | 'func' Params ID Signature Block? ;
Decl = 'const' (ConstSpec | '(' (ConstSpec ';')* ConstSpec? ')') | 'var' (VarSpec | '(' (VarSpec ';')* VarSpec? ')') | 'type' (TypeSpec | '(' (TypeSpec ';')* TypeSpec? ')') ;
ConstSpec = Ids (Type? '=' Exprs)? ;
VarSpec = Ids (Type ('=' Exprs)? | '=' Exprs) ;
TypeSpec = ID TParams? '='? Type ;
TParams = '[' sep(TParam, ',') ','? ']' ;
TParam = Ids Union ;
Union = sep(Term, '|') ;
Term = '~'? Type ;
Ids = sep(ID, ',') ;
Signature = Params (Params | Type)? ;
Params = '(' (sep(Param, ',') ','?)? ')' ;
Param = ID? '...'? Type | ID ;
Type = TypeName | '[' ('...' | Expr)? ']' Type | '*' Type | 'func' Signature | Struct | Interface | 'map' '[' Type ']' Type | 'chan' '<-'? Type | '<-' 'chan' Type | '(' Type ')' ;
TypeName = ID ('.' ID)? ('[' sep(Type, ',') ','? ']')? ;
Struct = 'struct' '{' (Field ';')* Field? '}' ;
Field = (Ids Type | '*'? TypeName | '(' '*'? TypeName ')') STR? ;
Interface = 'interface' '{' (Elem ';')* Elem? '}' ;
Elem = ID Signature | Union ;
Block = '{' Stmts '}' ;
Stmts = (Stmt? ';')* Stmt? ;
Stmt = Decl | ID ':' Stmt? | Simple | ('go' | 'defer') Expr | 'return' Exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | Block | If | Switch | Select | For ;
If = 'if' (SimpleC? ';')? ExprC Block ('else' (If | Block))? ;
Switch = 'switch' (SimpleC? ';')? SimpleC? '{' (('case' sep(Item, ',') | 'default') ':' Stmts)* '}' ;
Item = Expr | Type ;
Select = 'select' '{' (('case' Simple | 'default') ':' Stmts)* '}' ;
For = 'for' (SimpleC? ';' ExprC? ';' SimpleC? | ExprC | (ExprsC ('=' | ':='))? 'range' ExprC)? Block ;
Literal = '{' (sep(KeyVal, ',') ','?)? '}' ;
KeyVal = Val (':' Val)? ;
Val = Expr | Literal ;
Args = '(' (sep(Item, ',') '...'? ','?)? ')' ;
Index = '[' (Expr? ':' Expr? (':' Expr)? | sep(Item, ',') ','?) ']' ;
LiteralType = '[' ('...' | Expr)? ']' Type | 'map' '[' Type ']' Type | Struct ;
"""
_GO_EXPR = """
Simple@ = Exprs@ ((AssignOp | ':=') Exprs@ | '++' | '--' | '<-' Expr@)? ;
Exprs@ = sep(Expr@, ',') ;
Expr@ = sep(Unary@, BinOp) ;
Unary@ = UnOp* Primary@ ;
Primary@ = Operand Suffix@* ;
Suffix@ = '.' (ID | '(' (Type | 'type') ')') | Index | Args LIT ;
"""
_GO_OPERAND = "Operand = NUM | STR | CHAR | ID | '(' (Expr | Type) ')' | 'func' Signature Block? | LiteralType Literal? | Interface | 'chan' '<-'? Type ;\n"
GO = (
    GO_SHARED
    + _GO_OPERAND
    + _GO_EXPR.replace("@", "").replace(" LIT ;", " | Literal ;")
    + _GO_EXPR.replace("@", "C").replace(" LIT ;", " ;")
)

_RUST_SHARED = """
%class Id = ID 'union' 'auto' 'default' 'macro_rules' 'raw' 'safe' ;
%class AssignOp = '=' '+=' '-=' '*=' '/=' '%=' '^=' '&=' '|=' '<<=' ;
%class Close = '>' '>~' ;
%class Lit = NUM STR CHAR 'true' 'false' ;
%class Plain = DOC IDOC ID LIFE NUM STR CHAR 'as' 'async' 'await' 'break' 'const' 'continue' 'crate' 'dyn' 'else' 'enum' 'extern' 'false' 'fn' 'for' 'if' 'impl' 'in' 'let'
  'loop' 'match' 'mod' 'move' 'mut' 'pub' 'ref' 'return' 'self' 'Self' 'static' 'struct' 'super' 'trait' 'true' 'type' 'unsafe' 'use' 'where' 'while' 'abstract' 'become'
  'box' 'do' 'final' 'macro' 'override' 'priv' 'try' 'typeof' 'unsized' 'virtual' 'yield' 'union' 'auto' 'default' 'macro_rules' 'raw' 'safe' '_'
  '+' '-' '*' '/' '%' '^' '!' '&' '|' '&&' '||' '<<' '+=' '-=' '*=' '/=' '%=' '^=' '&=' '|=' '<<=' '=' '==' '!=' '<' '<=' '@' '.' '..' '...' '..=' ',' ';' ':' '::'
  '->' '=>' '#' '$' '?' '~' '>' '>~' ;
Rust = Inner* Item* ;
Inner = IDOC | '#' '!' '[' Tree* ']' ;
Outer = DOC | '#' '[' Tree* ']' ;
Tree = Plain | '(' Tree* ')' | '[' Tree* ']' | '{' Tree* '}' ;
Group = '(' Tree* ')' | '[' Tree* ']' | '{' Tree* '}' ;
Vis = 'pub' ('(' ('crate' | 'self' | 'super' | 'in' '::'? sep(Seg, '::')) ')')? ;
Seg = Id | 'self' | 'super' | 'crate' | 'Self' | '$' 'crate' ;
Item = Outer* (Vis? Decl | SimplePath '!' Id? ('(' Tree* ')' ';' | '[' Tree* ']' ';' | '{' Tree* '}')) ;
SimplePath = '::'? sep(Seg, '::') ;
Decl = Use | Mod | Fn | Struct | Enum | UnionDecl | Trait | Impl | Alias | Const | Static | ExternCrate | ExternBlock | 'macro' Id Group Group? ;
Use = 'use' UseTree ';' ;
UseTree = ('::'? (sep(Seg, '::') '::')?)? ('*' | '{' (sep(UseTree, ',') ','?)? '}') | '::'? sep(Seg, '::') ('as' (Id | '_'))? ;
Mod = 'unsafe'? 'mod' Id (';' | '{' Inner* Item* '}') ;
Fn = 'default'? 'const'? 'async'? ('unsafe' | 'safe')? ('extern' STR?)? 'fn' Id Generics? '(' Params? ')' ('->' Type)? Where? (Block | ';') ;
Params = sep(Param, ',') ','? ;
Param = Outer* (('&' LIFE?)? 'mut'? 'self' (':' Type)? | Pattern ':' (Type | '...') | Type | '...') ;
Generics = '<' (sep(GenericParam, ',') ','?)? Close ;
GenericParam = Outer* (LIFE (':' Bounds?)? | Id (':' Bounds?)? ('=' Type)? | 'const' Id ':' Type ('=' (Block | '-'? Lit | Id))?) ;
Bounds = sep(Bound, '+') '+'? ;
Bound = LIFE | ('?' | '~' 'const' | 'const' | 'async')* ForLife? ('?')? TypePath | '(' '?'? ForLife? TypePath ')' | 'use' '<' (sep(UseArg, ',') ','?)? Close ;
UseArg = LIFE | Id | 'Self' ;
ForLife = 'for' Generics ;
Where = 'where' (sep(Pred, ',') ','?)? ;
Pred = LIFE ':' Bounds? | ForLife? Type ':' Bounds? ;
Struct = 'struct' Id Generics? (Where? Fields | Where? ';' | '(' (sep(TupleField, ',') ','?)? ')' Where? ';') ;
Fields = '{' (sep(FieldDecl, ',') ','?)? '}' ;
FieldDecl = Outer* Vis? Id ':' Type ('=' Expr)? ;
TupleField = Outer* Vis? Type ;
UnionDecl = 'union' Id Generics? Where? Fields ;
Enum = 'enum' Id Generics? Where? '{' (sep(Variant, ',') ','?)? '}' ;
Variant = Outer* Vis? Id (Fields | '(' (sep(TupleField, ',') ','?)? ')')? ('=' Expr)? ;
Trait = 'unsafe'? 'auto'? 'trait' Id Generics? (':' Bounds?)? (Where? '{' Inner* Assoc* '}' | '=' Bounds? Where? ';') ;
Impl = 'default'? 'unsafe'? 'impl' Generics? 'const'? '!'? Type ('for' Type)? Where? '{' Inner* Assoc* '}' ;
Assoc = Outer* (Vis? (Fn | 'default'? AssocType | 'default'? Const) | SimplePath '!' ('(' Tree* ')' ';' | '[' Tree* ']' ';' | '{' Tree* '}')) ;
AssocType = 'type' Id Generics? (':' Bounds?)? Where? ('=' Type)? Where? ';' ;
Alias = 'type' Id Generics? (':' Bounds?)? Where? ('=' Type)? Where? ';' ;
Const = 'const' (Id | '_') (':' Type)? ('=' Expr)? ';' ;
Static = ('unsafe' | 'safe')? 'static' 'mut'? Id ':' Type ('=' Expr)? ';' ;
ExternCrate = 'extern' 'crate' (Id | 'self') ('as' (Id | '_'))? ';' ;
ExternBlock = 'unsafe'? 'extern' STR? '{' Inner* ForeignItem* '}' ;
ForeignItem = Outer* (Vis? (Fn | Static | Alias) | SimplePath '!' ('(' Tree* ')' ';' | '[' Tree* ']' ';' | '{' Tree* '}')) ;
Type = TypeNoBounds ('+' Bounds?)? | ('impl' | 'dyn') Bounds ;
TypeNoBounds = '(' (sep(Type, ',') ','?)? ')' | '!' | '*' ('mut' | 'const') TypeNoBounds | ('&' | '&&') LIFE? 'mut'? TypeNoBounds | '[' Type (';' Expr)? ']' | '_'
  | ForLife? 'unsafe'? ('extern' STR?)? 'fn' '(' (sep(FnArg, ',') ','?)? ')' ('->' TypeNoBounds)? | ForLife? TypePath | TypePath '!' Group | ('impl' | 'dyn') ForLife? Bound ;
FnArg = Outer* ((Id | '_' | 'mut' Id) ':')? Type | '...' ;
TypePath = '<' Type ('as' TypePath)? Close ('::' TypeSeg)+ | '::'? sep(TypeSeg, '::') ;
TypeSeg = Seg ('::'? GenericArgs | '(' (sep(Type, ',') ','?)? ')' ('->' TypeNoBounds)?)? ;
GenericArgs = '<' (sep(GenericArg, ',') ','?)? Close ;
GenericArg = LIFE | Type | Block | '-'? Lit | Id GenericArgs? ('=' (Type | Block | '-'? Lit) | ':' Bounds) ;
Pattern = '|'? sep(OnePattern, '|') ;
OnePattern = 'ref'? 'mut'? Id ('@' OnePattern)? | '_' | '..' | ('&' | '&&') 'mut'? OnePattern | '(' (sep(Pattern, ',') ','?)? ')' | '[' (sep(Pattern, ',') ','?)? ']'
  | PathExpr ('{' (sep(FieldPattern, ',') ','?)? '}' | '(' (sep(Pattern, ',') ','?)? ')')? | RangeEnd (('..' | '..=' | '...') RangeEnd?)? | ('..=' | '..') RangeEnd | SimplePath '!' Group | 'const' Block | 'box' OnePattern ;
RangeEnd = '-'? Lit | PathExpr ;
FieldPattern = Outer* ('..' | (Id | NUM) ':' Pattern | 'box'? 'ref'? 'mut'? Id) ;
PathExpr = ('<' Type ('as' TypePath)? Close '::' | '::')? sep(ExprSeg, '::') ;
ExprSeg = Seg ('::' GenericArgs)? ;
Block = '{' Inner* Stmt* ExprInner? '}' ;
ExprInner = Outer* Expr ;
Stmt = ';' | Outer* Let | Item | Outer* BlockLike | Outer* Expr ';' | SimplePath '!' '{' Tree* '}' ;
Let = 'let' Pattern (':' Type)? ('=' Expr ('else' Block)?)? ';' ;
BlockLike = ('unsafe' | 'const' | 'async' 'move'? | LIFE ':')? Block | If | Match | (LIFE ':')? Loop ;
If = 'if' ExprC Block ('else' (If | Block))? ;
Match = 'match' ExprC '{' Inner* Arm* LastArm? '}' ;
Arm = Outer* Pattern ('if' Expr)? '=>' (Expr ',' | BlockLike ','?) ;
LastArm = Outer* Pattern ('if' Expr)? '=>' Expr ;
Loop = 'loop' Block | 'while' ExprC Block | 'for' Pattern 'in' ExprC Block ;
Closure = ForLife? 'static'? 'async'? 'move'? ('||' | '|' (sep(ClosureParam, ',') ','?)? '|') ;
ClosureParam = Outer* OnePattern (':' Type)? ;
FieldInit = Outer* ((Id | NUM) (':' Expr)?) | '..' Expr? ;
Args = '(' (sep(ExprInner, ',') ','?)? ')' ;
BinOp = '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '&&' | '||' | '<<' | '>~' '>' | '==' | '!=' | '<' | '<=' | '>' | '>~' '=' ;
"""
_RUST_EXPR = """
Expr@ = Unit@ (BinOp Unit@ | 'as' TypeNoBounds | ('..' | '..=') Unit@? | AssignOp Unit@ | '>~' '>~' '=' Unit@)* | ('..' | '..=') (Unit@ (BinOp Unit@ | 'as' TypeNoBounds)*)? ;
Unit@ = ('-' | '*' | '!' | '&' ('raw' ('mut' | 'const') | 'mut')? | '&&' 'mut'?) Unit@ | Closure ('->' TypeNoBounds Block | Expr@) | 'return' Expr@? | 'break' LIFE? Expr@? | 'continue' LIFE? | 'yield' Expr@?
  | 'let' Pattern '=' Unit@ | Atom@ Suffix* ;
"""
_RUST_ATOM = """
Atom@ = Lit | '(' (sep(ExprInner, ',') ','?)? ')' | '[' (ExprInner (';' Expr | (',' ExprInner)* ','?))? ']' | PathExpr STRUCT | SimplePath '!' Group | BlockLike | '_' ;
"""
_RUST_SUFFIX = "Suffix = '.' (ExprSeg | NUM | 'await') | Args | '[' Expr ']' | '?' ;\n"
RUST = (
    _RUST_SHARED
    + _RUST_SUFFIX
    + (_RUST_EXPR + _RUST_ATOM).replace("@", "").replace(" STRUCT ", " ('{' (sep(FieldInit, ',') ','?)? '}')? ")
    + (_RUST_EXPR + _RUST_ATOM).replace("@", "C").replace(" STRUCT ", " ")
)


def _script(ts: bool) -> str:
    """ECMAScript 2022 modules and, with ``ts``, TypeScript 5."""
    t = lambda yes, no="": yes if ts else no
    soft = "'as' 'async' 'from' 'get' 'of' 'set' 'meta' 'target' 'accessor'"
    soft_types = (
        " 'abstract' 'asserts' 'constructor' 'declare' 'global' 'infer' 'is' 'keyof' 'module' 'namespace' 'never' 'out' 'override'"
        " 'readonly' 'require' 'satisfies' 'type' 'unique'"
    )
    words = (
        "'break' 'case' 'catch' 'class' 'const' 'continue' 'debugger' 'default' 'delete' 'do' 'else' 'enum' 'export' 'extends' 'false' 'finally' 'for'"
        " 'function' 'if' 'import' 'in' 'instanceof' 'new' 'null' 'return' 'super' 'switch' 'this' 'throw' 'true' 'try' 'typeof' 'var' 'void' 'while'"
        " 'with' 'yield' 'let' 'static' 'await' 'implements' 'interface' 'package' 'private' 'protected' 'public'"
    )
    strict = t(" 'let' 'static' 'implements' 'interface' 'package' 'private' 'protected' 'public' 'await' 'yield'")
    ann = t(" (':' Type)?")
    classes = """
%class ClassMod = 'static' 'public' 'private' 'protected' 'readonly' 'abstract' 'override' 'declare' 'accessor' 'async' ;
%class ParamMod = 'public' 'private' 'protected' 'readonly' 'override' ;
%class MemberEndMark = ',' ';' ;
"""
    out = t(classes) + f"""
%class Id = ID {soft}{t(soft_types)}{strict} ;
%class Word = Id {words} ;
%class AssignOp = '=' '+=' '-=' '*=' '/=' '%=' '**=' '<<=' '&=' '|=' '^=' '&&=' '||=' '??=' ;
%class Prefix = 'delete' 'void' 'typeof' '+' '-' '~' '!' '++' '--' 'await' ;
Script = Module* ;
Eos = ';' | <ASI> ;
Module = ImportDecl | ExportDecl | Item ;
ImportDecl = 'import' {t("'type'? ")}(STR | Clause 'from' STR) WithClause? Eos{t(" | 'import' 'type'? Id '=' (sep(Word, '.') | 'require' '(' STR ')') Eos")} ;
WithClause = 'with' '{{' (sep(WithItem, ',') ','?)? '}}' ;
WithItem = (Word | STR) ':' STR ;
Clause = Id (',' (Star | NamedImports))? | Star | NamedImports ;
Star = '*' 'as' Id ;
NamedImports = '{{' (sep(ImportSpec, ',') ','?)? '}}' ;
ImportSpec = {t("'type'? ")}(Id | (Word | STR) 'as' Id) ;
ExportDecl = 'export' ({t("'type'? ")}'*' ('as' (Word | STR))? 'from' STR WithClause? Eos | {t("'type'? ")}'{{' (sep(ExportSpec, ',') ','?)? '}}' ('from' STR WithClause?)? Eos
  | Decl | VarStmt | 'default' (Decl | 'async'? 'function' '*'? Function | ClassTail | {t("'abstract' ClassTail | ")}AssignS Eos){t(" | '=' Expr Eos | 'as' 'namespace' Id Eos | 'import' 'type'? Id '=' (sep(Word, '.') | 'require' '(' STR ')') Eos")}){t(" | Decorator+ 'export' 'default'? 'abstract'? ClassTail")} ;
ExportSpec = {t("'type'? ")}(Word | STR) ('as' (Word | STR))? ;
Decl = 'async'? 'function' '*'? Id Function | {t("Decorator* 'abstract'? ")}'class' Id ClassRest{t(" | TypeDecl")} ;
ClassTail = 'class' Id? ClassRest ;
VarStmt = ('var' | 'let') sep(VarDecl, ',') Eos | 'const' sep(ConstDecl, ',') Eos ;
VarDecl = Id{t("'!'? ").replace("'!'?", " '!'?")}{ann} ('=' Assign)? | Pattern{ann} '=' Assign ;
ConstDecl = (Id | Pattern){ann} '=' Assign ;
Pattern = '{{' (sep(BindProp, ',') ','?)? '}}' | '[' BindElems ']' ;
BindElems = ','* (sep(BindElem, Commas) ','*)? ;
Commas = ','+ ;
BindElem = '...'? Binding ('=' Assign)? ;
BindProp = '...' Id | Id ('=' Assign)? | PropName ':' Binding ('=' Assign)? ;
Binding = Id | Pattern ;
Params = '(' (sep(Param, ',') ','?)? ')' ;
Param = {t("Decorator* ParamMod* ")}('...' Binding{t(" '?'?")}{ann} | Binding{t(" '?'?")}{ann} ('=' Assign)?{t(" | 'this' (':' Type)?")}) ;
Function = {t("TParams? ")}Params{t(" (':' Type)?")} (FBody{t(" | Eos")}) ;
FBody = '{{' ItemF* '}}' ;
ClassRest = {t("TParams? ")}('extends' Post{t(" ")})? {t("('implements' sep(Type, ','))? ")}'{{' ClassElem* '}}' ;
ClassElem = ';' | 'static' '{{' ItemF* '}}' | {t("Decorator* ClassMod* ", "'static'? ")}(Method | ClassField) {t("| ClassMod* IndexSig MemberEnd")} ;
ClassField = {t("'accessor'? ")}(PropName | PRIV){t(" ('?' | '!')?")}{ann} ('=' Assign)? Eos ;
Method = ('async' '*'? | '*' | 'get' | 'set')? (PropName | PRIV){t(" '?'?")} Function ;
PropName = Word | STR | NUM | '[' Assign ']' ;
ArrowParams = Id | {t("TParams? ")}Params{t(" (':' Type)?")} ;
Yield = 'yield' ('*'? Assign)? ;
Unary = Prefix Unary | Post ('++' | '--')?{t(" | '<' Type Gt Unary")} | PRIV 'in' Unary ;
Tail = (BinOp Unary | '?' Assign ':' Assign{t(" | ('as' | 'satisfies') (Type | 'const')")})* ;
BinOp = '??' | '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>~' '=' | 'instanceof' | 'in' | '<<' | '>~' '>' | '>~' '>~' '>' | '+' | '-' | '*' | '/' | '%' | '**' ;
Post = Atom Suffix* ;
Suffix = '.' (Word | PRIV) | '?.' (Word | PRIV | '[' Expr ']' | {t("TArgs? ")}Args | Template) | '[' Expr ']' | Args | Template{t(" | '!' | TArgs (Args | Template)?")} ;
Args = '(' (sep(Arg, ',') ','?)? ')' ;
Arg = '...'? Assign ;
Template = TEMPLATE | THEAD Expr (TMID Expr)* TTAIL ;
Array = '[' ','* (sep(Arg, Commas) ','*)? ']' ;
Object = '{{' (sep(Prop, ',') ','?)? '}}' ;
Prop = Id ('=' Assign)? | PropName ':' Assign | Method | '...' Assign ;
AtomKind = 'this' | Id | NUM | STR | REGEX | Template | 'true' | 'false' | 'null' | Array | '(' Expr ')' | 'super' | 'new' ('.' 'target' | Post) | 'import' ('.' 'meta' | '(' Assign (',' Assign)? ','? ')') ;
Expr = sep(Assign, ',') ;
Paren = '(' Expr ')' ;
"""
    assign = """
Assign@ = ARROW | Yield | Prefix Unary Tail | PRIV 'in' Unary Tail | Post@ (AssignOp Assign | '>~' '>~' '=' Assign | '>~' '>~' '>~' '=' Assign | ('++' | '--')? Tail)CAST ;
Post@ = Atom@ Suffix* ;
"""
    cast = t(" | '<' Type Gt Unary Tail | Post@ ('as' | 'satisfies') Type AssignOp Assign").replace("Post@", "Post")
    arrow = "'async'? ArrowParams '=>' (FBody | AssignB)"
    for s in ("", "S", "B"):
        text = assign.replace("CAST", cast).replace("ARROW", arrow)
        if s == "":
            text = text.replace("Post@ = Atom@ Suffix* ;\n", "")
        out += text.replace("@", s)
    out += "Atom = AtomKind | Object | 'async'? 'function' '*'? Id? Function | ClassTail ;\n"
    out += "AtomB = AtomKind | 'async'? 'function' '*'? Id? Function | ClassTail ;\n"
    out += "AtomS = AtomKind ;\n"
    out += "ExprS = AssignS (',' Assign)* ;\n"
    stmt = """
Item@ = Decl | VarStmt | Stmt@ ;
Block@ = '{' Item@* '}' ;
Stmt@ = Block@ | ';' | ExprS Eos | 'if' Paren Stmt@ ('else' Stmt@)? | 'while' Paren Stmt@ | 'do' Stmt@ 'while' Paren ';'? | 'for' 'await'? '(' ForHead ')' Stmt@ | 'continue' Id? Eos | 'break' Id? Eos
  | 'switch' Paren '{' (('case' Expr | 'default') ':' Item@*)* '}' | Id ':' (Stmt@ | 'function' Id Function) | 'throw' Expr Eos | 'try' Block@ ('catch' ('(' Binding ANN ')')? Block@ ('finally' Block@)? | 'finally' Block@) | 'debugger' Eos RETURN ;
"""
    stmt = stmt.replace("ANN", t("(':' Type)?"))
    out += stmt.replace("@", "").replace("RETURN", "")
    out += stmt.replace("@", "F").replace("RETURN", "| 'return' Expr? Eos")
    out += f"""
ForHead = ('var' | 'let' | 'const') (Id | Pattern){ann} ('in' Expr | 'of' Assign) | Post 'in' Expr | Post 'of' Assign | (('var' | 'let' | 'const') sep(VarDecl, ',') | Expr)? ';' Expr? ';' Expr? ;
"""
    if ts:
        out += """
Gt = '>' | '>~' ;
Decorator = '@' (Paren | sep(Word, '.') TArgs? Args*) ;
TypeDecl = 'declare'? (Interface | Alias | Enum | Namespace) | 'declare' ('namespace' | 'module') sep(Id, '.') AmbientBody | 'declare' ('async'? 'function' '*'? Id Function | 'abstract'? 'class' Id ClassRest | VarDeclare | 'global' AmbientBody | 'module' STR (AmbientBody | Eos)) ;
VarDeclare = ('var' | 'let' | 'const') sep(AmbientVar, ',') Eos ;
Interface = 'interface' Id TParams? ('extends' sep(Type, ','))? ObjType ;
Alias = 'type' Id TParams? '=' Type Eos ;
Enum = 'const'? 'enum' Id '{' (sep(EnumMember, ',') ','?)? '}' ;
EnumMember = PropName ('=' Assign)? ;
Namespace = ('namespace' | 'module') sep(Id, '.') NsBody ;
NsBody = '{' Module* '}' ;
AmbientBody = '{' (Module | 'export'? ('const' | 'let' | 'var') sep(AmbientVar, ',') Eos)* '}' ;
AmbientVar = Id (':' Type)? ;
TParams = '<' sep(TParam, ',') ','? Gt ;
TParam = ('const' | 'in' | 'out')* Id ('extends' Type)? ('=' Type)? ;
TArgs = '<' sep(Type, ',') Gt ;
Type = Joined ('extends' Joined '?' Type ':' Type)? | FnType | ('asserts')? (Id | 'this') 'is' Type | 'asserts' (Id | 'this') ;
FnType = TParams? Params '=>' Type | 'abstract'? 'new' TParams? Params '=>' Type ;
Joined = ('|' | '&')? sep(TypeOp, JoinOp) ;
JoinOp = '|' | '&' ;
TypeOp = ('keyof' | 'unique' | 'readonly') TypeOp | 'infer' Id ('extends' TypeOp)? | TypeAtom ('[' Type? ']')* ;
TypeAtom = Id ('.' Word)* TArgs? | 'void' | 'null' | 'true' | 'false' | 'this' | STR | '-'? NUM | TEMPLATE | THEAD Type (TMID Type)* TTAIL | 'typeof' (Id | 'this' | 'import' '(' STR ')') ('.' (Word | PRIV))* TArgs?
  | 'import' '(' Type (',' Object)? ','? ')' ('.' Word)* TArgs? | '(' Type ')' | ObjType | '[' (sep(TupleItem, ',') ','?)? ']' ;
TupleItem = '...'? (Word '?'? ':')? Type '?'? ;
ObjType = '{' (TypeMember (MemberEnd TypeMember)* MemberEnd?)? '}' | '{' MappedMod? '[' Id 'in' Type ('as' Type)? ']' (('+' | '-')? '?')? (':' Type)? (';' | ',')? '}' ;
MappedMod = ('+' | '-')? 'readonly' ;
MemberEnd = MemberEndMark | <ASI> ;
TypeMember = 'readonly'? PropName '?'? (':' Type)? | PropName '?'? TParams? Params (':' Type)? | ('get' | 'set') PropName Params (':' Type)? | TParams? Params (':' Type)? | 'new' TParams? Params (':' Type)? | 'readonly'? IndexSig ;
IndexSig = '[' Id ':' Type ']' (':' Type)? ;
"""
    return out


JAVASCRIPT = _script(False)
TYPESCRIPT = _script(True)
