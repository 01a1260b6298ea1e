"""The grammars, bundled as text. They describe the languages' public syntax in the notation of ``tables``."""

PYTHON = """
file: (stmt | NEWLINE)+ ;
stmt: line | compound ;
line: {small ';'} ';'? NEWLINE ;
small: assign | stars | yield | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (test ('from' test)?)?
  | ('global' | 'nonlocal') {NAME ','} | 'del' {target ','} ','? | 'assert' test (',' test)? | import | 'type' NAME tparams? '=' test ;
assign: (targets '=')+ value | single ':' test ('=' value)? | single AUG value ;
value: stars | yield ;
yield: 'yield' stars? | 'yield' 'from' test ;
single: NAME | primary '.' NAME | primary '[' subs ']' | '(' single ')' ;
targets: startarget | {startarget ','} ',' | startarget ',' {startarget ','} ;
startarget: '*'? target ;
target: NAME | primary '.' NAME | primary '[' subs ']' | '(' targets? ')' | '[' targets? ']' ;
import: 'import' {dotted_as ','} | 'from' dots? dotted 'import' names | 'from' dots 'import' names ;
dots: ('.' | '...')+ ;
dotted: {NAME '.'} ;
dotted_as: dotted ('as' NAME)? ;
names: '*' | {name_as ','} | '(' {name_as ','} ','? ')' ;
name_as: NAME ('as' NAME)? ;

test: or ('if' or 'else' test)? | lambda ;
named: NAME ':=' test | test ;
or: {not orop} ;
orop: 'or' | 'and' ;
not: 'not' not | cmp ;
cmp: {arith cmpop} ;
cmpop: '<' | '>' | '==' | '!=' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
arith: {unary binop} ;
binop: '+' | '-' | '*' | '/' | '//' | '%' | '@' | '&' | '|' | '^' | '<<' | '>>' ;
unary: ('+' | '-' | '~') unary | power ;
power: await ('**' unary)? ;
await: 'await'? primary ;
primary: atom | primary '.' NAME | primary '(' args? ')' | primary '[' subs ']' ;
atom: NAME | NUMBER | STRING+ | BYTES+ | '...' | 'None' | 'True' | 'False' | '(' ')' | '(' yield ')' | '(' starnamed compfor ')' | '(' starnames ')'
  | '[' ']' | '[' starnamed compfor ']' | '[' starnames ']' | '{' '}' | '{' starnamed compfor '}' | '{' starnames '}' | '{' pair compfor '}' | '{' {pair ','} ','? '}' ;
pair: test ':' test | '**' arith ;
starnamed: named | '*' arith ;
starnames: {starnamed ','} ','? ;
starred: test | '*' arith ;
stars: {starred ','} ','? ;
compfor: compone+ ;
compone: 'async'? 'for' targets 'in' or compif* | 'async'? 'for' targets 'in' or 'if' or 'else' test compif* ;
compif: 'if' compcond ;
compcond: or | NAME ':=' test | lambda ;
subs: {sub ','} ','? ;
sub: named | '*' arith | test? ':' test? (':' test?)? ;
args: {arg ','} ','? ;
arg: named | named compfor | NAME '=' test | '*' test | '**' test ;
lambda: 'lambda' ({lparam ','} ','?)? ':' test ;
lparam: NAME ('=' test)? | '*' NAME? | '**' NAME | '/' ;

compound: if | while | for | try | with | decorated | def | class | match ;
block: line | NEWLINE INDENT stmt+ DEDENT ;
if: 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)? ;
while: 'while' named ':' block ('else' ':' block)? ;
for: 'async'? 'for' targets 'in' stars ':' block ('else' ':' block)? ;
try: 'try' ':' block except+ ('else' ':' block)? ('finally' ':' block)? | 'try' ':' block 'finally' ':' block ;
except: 'except' ('*'? test ('as' NAME)?)? ':' block ;
with: 'async'? 'with' {item ','} ':' block | 'async'? 'with' '(' {item ','} ','? ')' ':' block ;
item: test ('as' startarget)? ;
decorated: ('@' named NEWLINE)+ (def | class) ;
def: 'async'? 'def' NAME tparams? '(' ({param ','} ','?)? ')' ('->' test)? ':' block ;
param: NAME (':' test)? ('=' test)? | '*' | '*' NAME (':' starred)? | '**' NAME (':' test)? | '/' ;
tparams: '[' {tparam ','} ','? ']' ;
tparam: NAME (':' test)? ('=' test)? | '*' NAME ('=' starred)? | '**' NAME ('=' test)? ;
class: 'class' NAME tparams? ('(' args? ')')? ':' block ;
match: 'match' subject ':' NEWLINE INDENT case+ DEDENT ;
subject: {starnamed ','} ','? ;
case: 'case' patterns ('if' named)? ':' block ;
patterns: {pattern ','} ','? ;
pattern: '*' NAME | {closed '|'} ('as' NAME)? ;
closed: '-'? NUMBER (('+' | '-') NUMBER)? | STRING+ | BYTES+ | 'None' | 'True' | 'False' | {NAME '.'} | {NAME '.'} '(' ({parg ','} ','?)? ')'
  | '(' patterns? ')' | '[' patterns? ']' | '{' ({ppair ','} ','?)? '}' ;
parg: pattern | NAME '=' pattern ;
ppair: closed ':' pattern | '**' NAME ;
"""

GO = """
file: 'package' NAME ';' (imp ';')* (top ';')* ;
imp: 'import' spec | 'import' '(' ({spec ';'} ';'?)? ')' ;
spec: (NAME | '.')? STRING ;
top: decl | func ;
decl: 'const' cspec | 'const' '(' ({cspec ';'} ';'?)? ')' | 'var' vspec | 'var' '(' ({vspec ';'} ';'?)? ')' | 'type' tspec | 'type' '(' ({tspec ';'} ';'?)? ')' ;
cspec: {NAME ','} (type? '=' exprs)? ;
vspec: {NAME ','} type ('=' exprs)? | {NAME ','} '=' exprs ;
tspec: NAME tparams? '='? type ;
tparams: '[' {tparam ','} ','? ']' ;
tparam: {NAME ','} union ;
union: {uterm '|'} ;
uterm: '~'? type ;
func: 'func' ('(' params? ')')? NAME tparams? sig block? ;
sig: '(' params? ')' result? ;
result: type | '(' params? ')' ;
params: {param ','} ','? ;
param: type | NAME type | NAME? '...' type ;
type: tname | '(' type ')' | '*' type | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | chan | 'func' sig | struct | iface ;
tname: NAME ('.' NAME)? targs? ;
targs: '[' {type ','} ','? ']' ;
chan: 'chan' type | 'chan' '<-' type | '<-' 'chan' type ;
struct: 'struct' '{' ({field ';'} ';'?)? '}' ;
field: {NAME ','} type STRING? | '*'? tname STRING? ;
iface: 'interface' '{' ({imember ';'} ';'?)? '}' ;
imember: NAME sig | union ;

block: '{' stmts? '}' ;
stmts: {sstmt ';'} ';'? | ';' stmts ;
sstmt: stmt ';'* ;
stmt: decl | simple | 'go' expr | 'defer' expr | 'return' exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | block | if | switch | select | for | NAME ':' stmt | NAME ':' ;
simple: expr | expr '<-' expr | expr '++' | expr '--' | exprs '=' exprs | exprs ASSIGN exprs | exprs ':=' exprs ;
if: 'if' (simple? ';')? expr block ('else' (if | block))? ;
switch: 'switch' (simple? ';')? simple? '{' case* '}' ;
case: ('case' {ctype ','} | 'default') ':' stmts? ;
ctype: expr | type ;
select: 'select' '{' comm* '}' ;
comm: ('case' simple | 'default') ':' stmts? ;
for: 'for' block | 'for' expr block | 'for' simple? ';' expr? ';' simple? block | 'for' (exprs ('=' | ':='))? 'range' expr block ;

exprs: {expr ','} ;
expr: {unary binop} ;
binop: '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^' ;
unary: ('+' | '-' | '!' | '^' | '*' | '&' | '<-') unary | prim ;
prim: NAME | NUMBER | STRING | CHAR | '(' expr ')' | '(' type ')' | ltype lit | 'func' sig block | tname lit | conv '(' (expr ','?)? ')'
  | prim '.' NAME | prim '.' '(' (type | 'type') ')' | prim '[' index ']' | prim '(' args? ')' ;
index: expr ','? | {type ','} ','? | expr? ':' expr? (':' expr)? ;
args: {arg ','} '...'? ','? ;
arg: expr | conv ;
conv: '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | chan | iface | struct | 'func' sig | '*' conv ;
ltype: '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | struct ;
lit: '{' ({elem ','} ','?)? '}' ;
elem: (key ':')? key ;
key: expr | lit ;
"""

JAVA = """
file: item+ ;
item: (anno* 'package' qname ';') | 'import' 'static'? qname ('.' '*')? ';' | tdecl | ';' | module ;
module: anno* ('open')? 'module' qname '{' directive* '}' ;
directive: ('requires' ('transitive' | 'static')* qname | ('exports' | 'opens') qname ('to' {qname ','})? | 'uses' qname | 'provides' qname 'with' {qname ','}) ';' ;
qname: {NAME '.'} ;
mods: mod+ ;
mod: anno | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | NAME '-' NAME ;
anno: '@' qname ('(' annoargs? ')')? ;
annoargs: evalue | {annopair ','} ;
annopair: NAME '=' evalue ;
evalue: cond | anno | '{' ({evalue ','} ','?)? '}' ;
tdecl: mods? (classd | enumd | ifaced | annod | recordd) ;
classd: 'class' NAME tparams? ('extends' type)? ('implements' types)? ('permits' types)? body ;
ifaced: 'interface' NAME tparams? ('extends' types)? ('permits' types)? body ;
annod: '@' 'interface' NAME body ;
enumd: 'enum' NAME ('implements' types)? '{' {const ','}? ','? (';' member*)? '}' ;
const: anno* NAME ('(' args? ')')? body? ;
recordd: 'record' NAME tparams? '(' ({rparam ','})? ')' ('implements' types)? body ;
rparam: anno* type '...'? NAME ;
body: '{' member* '}' ;
member: ';' | 'static'? block | tdecl | field | method | ctor ;
field: mods? type {vdec ','} ';' ;
vdec: NAME dims? ('=' vinit)? ;
vinit: expr | '{' ({vinit ','} ','?)? '}' | '{' ',' '}' ;
method: mods? tparams? (type | 'void') NAME '(' params? ')' dims? ('throws' types)? (block | ';') | mods? type NAME '(' params? ')' dims? 'default' evalue ';' ;
ctor: mods? tparams? NAME ('(' params? ')')? ('throws' types)? block ;
params: {param ','} ;
param: mods? type anno* '...'? ({NAME '.'} '.')? (NAME | 'this') dims? ;
tparams: '<' {tparam ','} '>' ;
tparam: anno* NAME ('extends' {type '&'})? ;
types: {type ','} ;
type: anno* base dims? ;
base: prim | ref ;
prim: 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double' ;
ref: refpart | ref '.' anno* refpart ;
refpart: NAME targs? ;
targs: '<' '>' | '<' {targ ','} '>' ;
targ: type | anno* '?' (('extends' | 'super') type)? ;
dims: (anno* '[' ']')+ ;

block: '{' bstmt* '}' ;
bstmt: local ';' | tdecl | stmt ;
local: mods? type {vdec ','} ;
stmt: block | ';' | NAME ':' stmt | expr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' (local | exprs)? ';' expr? ';' exprs? ')' stmt | 'for' '(' mods? type NAME dims? ':' expr ')' stmt | 'for' '(' pattern ':' expr ')' stmt | switch | 'break' NAME? ';' | 'continue' NAME? ';'
  | 'return' expr? ';' | 'throw' expr ';' | 'synchronized' '(' expr ')' block | 'assert' expr (':' expr)? ';' | 'yield' expr ';' | try ;
switch: 'switch' '(' expr ')' '{' (group | arm)* '}' ;
group: label+ bstmt* ;
label: ('case' {clabel ','} guard? | 'default') ':' ;
arm: ('case' {clabel ','} guard? | 'default') '->' (expr ';' | block | 'throw' expr ';') ;
clabel: cond | pattern | 'default' ;
guard: 'when' cond ;
pattern: mods? type NAME | type '(' ({pattern ','})? ')' NAME? ;
try: 'try' block catch* 'finally' block | 'try' block catch+ | 'try' '(' {resource ';'} ';'? ')' block catch* ('finally' block)? ;
resource: mods? type NAME '=' expr | cond ;
catch: 'catch' '(' mods? {type '|'} NAME ')' block ;

exprs: {expr ','} ;
expr: lambda | cond | unary assignop expr ;
assignop: '=' | ASSIGN | '>' '>=' | '>' '>' '>=' ;
lambda: (NAME | '(' ({NAME ','})? ')' | '(' params ')') '->' (expr | block) ;
cond: bin | bin '?' expr ':' (cond | lambda) ;
bin: unary | bin binop unary | bin 'instanceof' (pattern | type | 'final' type) ;
binop: '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' ;
unary: ('+' | '-' | '++' | '--' | '!' | '~') unary | postfix | '(' prim dims? ')' unary | '(' {type '&'} ')' (castable | lambda) ;
castable: ('!' | '~') unary | postfix ;
postfix: primary | postfix '++' | postfix '--' ;
primary: lit | 'this' | 'super' | NAME | '(' expr ')' | new | switch | primary '.' NAME | primary '.' 'this' | primary '.' 'super' | primary '.' 'class' | primary '.' targs (NAME | 'super') args1 | primary args1
  | primary '[' expr ']' | primary '::' targs? (NAME | 'new') | (prim dims? | ref dims) '.' 'class' | (ref targs | prim dims | ref dims) '::' targs? (NAME | 'new') | ref '::' targs? (NAME | 'new') | 'void' '.' 'class' | primary '.' new | targs NAME args1 ;
args1: '(' args? ')' ;
args: {expr ','} ;
lit: NUMBER | STRING | CHAR | 'true' | 'false' | 'null' ;
new: 'new' targs? anno* ref args1 body? | 'new' anno* base (anno* '[' expr ']')+ dims? | 'new' anno* base dims '{' ({vinit ','} ','?)? '}' ;
"""

C = """
file: top+ ;
top: fundef | decl | ';' | 'asm' '(' STRING+ ')' ';' | '__extension__' top ;
fundef: specs? declarator attr* decl* block ;
decl: specs {idecl ','}? attr* ';' | assertd ;
assertd: ('_Static_assert' | 'static_assert') '(' expr (',' STRING+)? ')' ';' ;
idecl: declarator attr* ('=' init)? ;
specs: spec+ ;
spec: 'typedef' | 'extern' | 'static' | 'auto' | 'register' | '_Thread_local' | 'thread_local' | 'inline' | '_Noreturn' | 'constexpr' | tspec | tqual | attr | ('_Alignas' | 'alignas') '(' (tname | expr) ')' | '__extension__' ;
tspec: 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | 'bool' | '_Atomic' '(' tname ')' | 'typeof' '(' (tname | expr) ')' | struct | enum | NAME ;
tqual: 'const' | 'volatile' | 'restrict' | '_Atomic' ;
attr: '__attribute__' '(' '(' balanced* ')' ')' | '[' '[' balanced* ']' ']' | 'asm' '(' STRING+ ')' ;
balanced: '(' balanced* ')' | NAME | NUMBER | STRING+ | CHAR | ',' | 'const' | 'int' | 'char' | 'void' | 'long' | 'unsigned' | '=' | '*' | '+' | '-' | '&' | '<<' | '|' | '::' | ':' | 'sizeof' | 'inline' | 'restrict' ;
struct: ('struct' | 'union') attr* NAME? '{' member* '}' attr* | ('struct' | 'union') attr* NAME ;
member: specs {mdecl ','}? attr* ';' | ';' | assertd ;
mdecl: declarator attr* (':' cond)? attr* | ':' cond ;
enum: 'enum' attr* NAME? (':' specs)? '{' {ecount ','} ','? '}' attr* | 'enum' attr* NAME (':' specs)? ;
ecount: NAME attr* ('=' cond)? ;
declarator: pointer? direct ;
pointer: ('*' (tqual | attr)*)+ ;
direct: NAME | '(' attr* declarator ')' | direct '[' arr? ']' | direct '(' params? ')' | direct '(' {NAME ','} ')' ;
arr: ('static' | tqual)* assign | '*' | tqual+ ;
params: {param ','} (',' '...')? | '...' ;
param: specs declarator attr* | specs abstract? ;
abstract: pointer | pointer? adirect ;
adirect: '(' abstract ')' | adirect? '[' arr? ']' | adirect? '(' params? ')' ;
tname: specs abstract? ;
init: assign | '{' ({ditem ','} ','?)? '}' ;
ditem: (desig+ '=')? init | NAME ':' init ;
desig: '[' cond ('...' cond)? ']' | '.' NAME ;

block: '{' bitem* '}' ;
bitem: decl | stmt | fundef ;
stmt: block | expr? ';' | label stmt | label '}' | 'if' '(' expr ')' stmt ('else' stmt)? | 'switch' '(' expr ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' (expr? ';' | decl) expr? ';' expr? ')' stmt | 'goto' (NAME | '*' expr) ';' | 'continue' ';' | 'break' ';' | 'return' init? ';' | 'return' expr ';' | asm | attr ';' ;
label: NAME ':' attr* | 'case' cond ('...' cond)? ':' | 'default' ':' ;
asm: 'asm' ('volatile' | 'goto' | 'inline')* '(' asmpart* ')' ';' ;
asmpart: STRING+ | ':' | '::' | ',' | '[' NAME ']' | '(' expr ')' | NAME ;

expr: {assign ','} ;
assign: cond | unary ('=' | ASSIGN) assign ;
cond: bin | bin '?' expr? ':' cond ;
bin: cast | bin binop cast ;
binop: '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '+' | '-' | '*' | '/' | '%' ;
cast: unary | '(' tname ')' cast ;
unary: postfix | ('++' | '--') unary | ('&' | '*' | '+' | '-' | '~' | '!' | '&&' | '__extension__') cast | 'sizeof' unary | ('sizeof' | '_Alignof' | 'alignof') '(' tname ')' ;
postfix: primary | postfix '[' expr ']' | postfix '(' ({carg ','})? ')' | postfix ('.' | '->') NAME | postfix ('++' | '--') | '(' tname ')' '{' ({ditem ','} ','?)? '}' ;
carg: assign | tname ;
primary: NAME | NUMBER | CHAR | strings | '(' expr ')' | '(' block ')' | '_Generic' '(' assign ',' {gassoc ','} ')' | 'nullptr' ;
strings: (STRING | NAME)* STRING (STRING | NAME)* ;
gassoc: (tname | 'default') ':' assign ;
"""

RUST = """
file: inner* item* last ;
last: item | inner ;
inner: '#' '!' '[' tokens? ']' ;
attr: '#' '[' tokens? ']' ;
tokens: tree+ ;
tree: '(' tokens? ')' | '[' tokens? ']' | '{' tokens? '}' | leaf ;
item: attr* vis? kind | attr* macro_item ;
vis: 'pub' ('(' ('crate' | 'self' | 'super' | 'in' path) ')')? ;
kind: fn | 'const' (NAME | '_') (':' type)? ('=' expr)? ';' | 'static' 'mut'? NAME ':' type ('=' expr)? ';' | 'type' NAME generics? (':' bounds)? where? ('=' type)? where? ';' | struct | enum | union | trait | impl
  | 'use' usetree ';' | 'mod' NAME (';' | '{' inner* item* '}') | 'unsafe'? 'extern' STRING? '{' inner* item* '}' | 'extern' 'crate' (NAME | 'self') ('as' (NAME | '_'))? ';' | 'unsafe' 'mod' NAME '{' item* '}' ;
macro_item: spath '!' NAME? (('(' tokens? ')' | '[' tokens? ']') ';' | '{' tokens? '}') ;
fnq: ('const' | 'async' | 'unsafe' | 'safe' | 'default' | 'extern' STRING?)+ ;
fn: fnq? 'fn' NAME generics? '(' ({param ','} ','?)? ')' ('->' type)? where? (block | ';') ;
param: attr* (self | pat ':' type | '...' | pat ':' '...' | type) ;
self: ('&' LIFE?)? 'mut'? 'self' | 'mut'? 'self' ':' type ;
generics: '<' ({gparam ','} ','?)? '>' ;
gparam: attr* (LIFE (':' lbounds?)? | NAME (':' bounds?)? ('=' type)? | 'const' NAME ':' type ('=' gconst)?) ;
gconst: block | NAME | '-'? NUMBER | CHAR | 'true' | 'false' ;
lbounds: {LIFE '+'} '+'? ;
bounds: {bound '+'} '+'? ;
bound: LIFE | '(' bound1 ')' | bound1 | 'use' gargs ;
bound1: ('?' | '~' 'const' | 'const')? forlife? tpath ;
forlife: 'for' '<' ({gparam ','} ','?)? '>' ;
where: 'where' ({wpred ','} ','?)? ;
wpred: LIFE ':' lbounds? | forlife? type ':' bounds? ;
struct: 'struct' NAME generics? (where? fields | where? ';' | tfields where? ';') ;
union: 'union' NAME generics? where? fields ;
fields: '{' ({field ','} ','?)? '}' ;
field: attr* vis? NAME ':' type ('=' expr)? ;
tfields: '(' ({tfield ','} ','?)? ')' ;
tfield: attr* vis? type ;
enum: 'enum' NAME generics? where? '{' ({variant ','} ','?)? '}' ;
variant: attr* vis? NAME (fields | tfields)? ('=' expr)? ;
trait: 'unsafe'? 'auto'? 'trait' NAME generics? (':' bounds?)? where? '{' inner* item* '}' ;
impl: 'default'? 'unsafe'? 'impl' generics? 'const'? ('!'? tpath 'for')? type where? '{' inner* item* '}' | 'default'? 'unsafe'? 'impl' generics? ('!'? type 'for')? type where? '{' inner* item* '}' ;
usetree: (spath? '::')? '*' | (spath? '::')? '{' ({usetree ','} ','?)? '}' | spath ('as' (NAME | '_'))? ;
spath: '::'? {seg '::'} ;
seg: NAME | 'self' | 'super' | 'crate' | 'Self' | '$' 'crate' ;
path: spath ;

type: tpath | '(' ({type ','} ','?)? ')' | '[' type ']' | '[' type ';' expr ']' | '&' LIFE? 'mut'? type | '&&' LIFE? 'mut'? type | '*' ('const' | 'mut') type | '!' | '_' | 'impl' bounds | 'dyn' bounds | fntype
  | '<' type ('as' tpath)? '>' '::' {tseg '::'} | tpath '!' ('(' tokens? ')' | '[' tokens? ']' | '{' tokens? '}') | forlife fntype | forlife tpath | LIFE '+' bounds | tpath '+' bounds ;
fntype: ('unsafe' | 'extern' STRING? | 'const' | 'async')* 'fn' '(' ({fparam ','} ','?)? ')' ('->' type)? ;
fparam: attr* ((NAME | '_') ':')? (type | '...') ;
tpath: '::'? {tseg '::'} ;
tseg: seg | seg '::'? gargs | seg '::'? '(' ({type ','} ','?)? ')' ('->' type)? ;
gargs: '<' ({garg ','} ','?)? '>' ;
garg: type | LIFE | '-'? NUMBER | STRING | CHAR | 'true' | 'false' | block | NAME gargs? '=' type | NAME gargs? '=' ('-'? NUMBER | 'true' | 'false' | block) | NAME gargs? ':' bounds ;

pat: '|'? {pat1 '|'} ;
pat1: 'ref'? 'mut'? NAME ('@' pat1)? | '_' | '..' | lit | '-' NUMBER | range | ('&' | '&&') 'mut'? pat1 | '(' ({pat ','} ','?)? ')' | '[' ({pat ','} ','?)? ']' | epath | epath '(' ({pat ','} ','?)? ')' | epath '{' ({fpat ','} ','?)? '}' | epath '!' mtree | 'box' pat1 | 'const' block ;
range: rend ('..=' | '...' | '..') rend | rend '..' | ('..=' | '..') rend ;
rend: '-'? NUMBER | CHAR | STRING | epath ;
fpat: attr* ('ref'? 'mut'? NAME | (NAME | NUMBER) ':' pat | '..') ;

block: '{' inner* stmts? '}' ;
stmts: stmt* (stmt | tail) ;
tail: attr* expr ;
stmt: ';' | attr* 'let' pat (':' type)? ('=' expr ('else' block)?)? ';' | item | attr* expr ';' | attr* blockexpr | attr* spath '!' '{' tokens? '}' ;
blockexpr: block | ('unsafe' | 'async' 'move'? | 'const') block | label? ('loop' block | 'while' cond block | 'for' pat 'in' cond block) | label block | if | match ;
label: LIFE ':' ;
if: 'if' cond block ('else' (block | if))? ;
match: 'match' cond '{' inner* ((arm)* armlast)? '}' ;
arm: attr* pat ('if' cond)? '=>' (expr ',' | blockexpr ','?) ;
armlast: arm | attr* pat ('if' cond)? '=>' expr ;
cond: expr ;
expr: assign ;
assign: range_e | range_e assignop assign ;
assignop: '=' | ASSIGN | '<' '<=' | '>' '>=' | '<<=' ;
range_e: bin | bin ('..' | '..=') bin? | ('..' | '..=') bin? ;
bin: unary | bin binop unary | bin 'as' type1 ;
type1: tpath | '(' ({type ','} ','?)? ')' | '[' type ']' | '[' type ';' expr ']' | '&' LIFE? 'mut'? type1 | 'dyn' bound1 | 'impl' bound1 | '*' ('const' | 'mut') type1 | '_' | fntype | '<' type ('as' tpath)? '>' '::' {tseg '::'} | '!' ;
binop: '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<' '<' | '>' '>' | '+' | '-' | '*' | '/' | '%' ;
unary: ('-' | '!' | '*') unary | ('&' | '&&') 'mut'? unary | '&' 'raw' ('const' | 'mut') unary | post | closure | jump | letcond ;
letcond: 'let' pat '=' bin_l ;
bin_l: unary ;
closure: ('static' | 'async' | 'move' | forlife | 'const')* ('||' | '|' ({cparam ','} ','?)? '|') (expr | '->' type block) ;
cparam: attr* pat1 (':' type)? ;
jump: 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE? | 'yield' expr? ;
post: primary | post '.' (NAME | NUMBER | 'await') | post '.' NAME '::' gargs | post '(' ({earg ','} ','?)? ')' | post '[' expr ']' | post '?' ;
earg: attr* expr ;
primary: lit | epath | '(' (attr* expr)? ')' | '(' earg ',' ({earg ','} ','?)? ')' | '[' ({earg ','} ','?)? ']' | '[' expr ';' expr ']' | epath '{' ({fexpr ','} ','?)? '}' | spath '!' mtree | blockexpr | '_' ;
mtree: '(' tokens? ')' | '[' tokens? ']' | '{' tokens? '}' ;
epath: '::'? {eseg '::'} | '<' type ('as' tpath)? '>' '::' {eseg '::'} ;
eseg: seg | seg '::' gargs ;
fexpr: attr* (NAME | (NAME | NUMBER) ':' expr | '..' expr | '..') ;
lit: NUMBER | STRING | CHAR | 'true' | 'false' ;
leaf: NAME | NUMBER | STRING | CHAR | LIFE | ASSIGN | WORD_LIST | PUNCT_LIST ;
"""

#: JavaScript; lines that begin with ``%`` belong to TypeScript only, lines with ``-`` to JavaScript only. ``@`` is replaced by
#: nothing and by ``_s``: expressions at the start of a statement, which begin with no brace, function or class.
SCRIPT = """
file: item+ ;
item: stmt | import | export ;
id: NAME | SOFT_LIST ;
word: id | KEYWORD_LIST ;
-import: 'import' STRING with? ';' | 'import' clause 'from' STRING with? ';' ;
%import: 'import' STRING with? ';' | 'import' clause 'from' STRING with? ';' | 'import' 'type' clause 'from' STRING with? ';' | 'import' 'type'? id '=' (qname | 'require' '(' STRING ')') ';' ;
with: ('with' | 'assert') object ;
clause: id | (id ',')? '*' 'as' id | (id ',')? '{' ({ispec ','} ','?)? '}' ;
-ispec: id | (word | STRING) 'as' id ;
%ispec: 'type'? id | 'type'? (word | STRING) 'as' id ;
-export: 'export' (var ';' | func | class | 'default' (func | class | assign ';') | '*' ('as' (word | STRING))? 'from' STRING with? ';' | '{' ({espec ','} ','?)? '}' ('from' STRING with?)? ';') | decorator+ 'export' 'default'? class ;
%export: 'export' (var ';' | func | class | 'default' (func | class | 'abstract' class | iface | assign ';') | 'type'? '*' ('as' (word | STRING))? 'from' STRING with? ';' | 'type'? '{' ({espec ','} ','?)? '}' ('from' STRING with?)? ';' | tdecl | '=' expr ';' | 'as' 'namespace' id ';' | import | 'default' fsig ';') | decorator+ 'export' 'default'? 'abstract'? class ;
-espec: (word | STRING) ('as' (word | STRING))? ;
%espec: 'type'? (word | STRING) ('as' (word | STRING))? ;

block: '{' stmt* '}' ;
stmt: block | var ';' | ';' | expr_s ';' | func | decorator* class | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'?
  | 'for' 'await'? '(' forhead ')' stmt | 'continue' id? ';' | 'break' id? ';' | 'return' expr? ';' | 'with' '(' expr ')' stmt | 'switch' '(' expr ')' '{' case* '}' | 'throw' expr ';' | try | 'debugger' ';' | id ':' stmt ;
%stmt: tdecl ;
forhead: (var | expr)? ';' expr? ';' expr? | ('var' | 'let' | 'const' | 'using' | 'await' 'using') binding ('=' assign)? ('in' | 'of') expr | lhs ('in' | 'of') expr ;
case: ('case' expr | 'default') ':' stmt* ;
try: 'try' block ('catch' ('(' cbinding ')')? block)? 'finally' block | 'try' block 'catch' ('(' cbinding ')')? block ;
-cbinding: binding ;
%cbinding: binding (':' type)? ;
var: ('var' | 'let' | 'const' | 'using' | 'await' 'using') {vdec ','} ;
-vdec: binding ('=' assign)? ;
%vdec: binding '!'? (':' type)? ('=' assign)? ;
binding: id | '[' bitems? ']' | '{' ({bprop ','} ','?)? '}' ;
bitems: ','+ | ','* {bitem sepc} ','* ;
sepc: ','+ ;
bitem: '...'? binding ('=' assign)? ;
bprop: id ('=' assign)? | pname ':' binding ('=' assign)? | '...' binding ;
-func: 'async'? 'function' '*'? id? '(' formals? ')' block ;
%func: 'async'? 'function' '*'? id? tparams? '(' formals? ')' ret? (block | ';') ;
%fsig: 'async'? 'function' '*'? id? tparams? '(' formals? ')' ret? ;
-fexpr: 'async'? 'function' '*'? id? '(' formals? ')' block ;
%fexpr: 'async'? 'function' '*'? id? tparams? '(' formals? ')' ret? block ;
formals: {formal ','} ','? ;
-formal: decorator* bitem ;
%formal: decorator* fmod* bitem | decorator* fmod* '...'? binding '?'? (':' type)? ('=' assign)? | 'this' (':' type)? ;
%fmod: 'public' | 'private' | 'protected' | 'readonly' | 'override' ;
decorator: '@' (id | decorator_path | '(' expr ')') ;
-decorator_path: (id | decorator_path) '.' word | (id | decorator_path) '(' args? ')' ;
%decorator_path: (id | decorator_path) '.' word | (id | decorator_path) targs? '(' args? ')' ;
-class: 'class' id? ('extends' lhs)? '{' member* '}' ;
%class: 'class' id? tparams? ('extends' lhs)? ('implements' types)? '{' member* '}' | ('abstract' | 'declare') class ;
-member: ';' | decorator* ('static' | 'accessor')* field ';' | decorator* 'static'? method | 'static' block ;
%member: ';' | decorator* cmod* field ';' | decorator* cmod* method | 'static' block | cmod* index ';' ;
%cmod: 'static' | 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare' | 'accessor' ;
-field: mname ('=' assign)? ;
%field: mname ('?' | '!')? (':' type)? ('=' assign)? ;
mname: pname | PRIVATE ;
pname: word | STRING | NUMBER | '[' assign ']' ;
-method: mkind? mname '(' formals? ')' block ;
%method: mkind? mname '?'? tparams? '(' formals? ')' ret? (block | ';') ;
mkind: 'get' | 'set' | '*' | 'async' '*'? ;
-omethod: mkind? pname '(' formals? ')' block ;
%omethod: mkind? pname '?'? tparams? '(' formals? ')' ret? block ;

expr: assign | expr ',' assign ;
expr_s: assign_s | expr_s ',' assign ;
assign@: cond@ | lhs@ aop assign | arrow | 'yield' ('*'? assign)? ;
aop: '=' | ASSIGN | '>>=' | '>>>=' | '>' '>=' | '>' '>' '>=' ;
-arrow: 'async'? (id | '(' formals? ')') '=>' (block | assign_s | fexpr | decorator* cexpr) ;
%arrow: 'async'? (id | tparams? '(' formals? ')' ret?) '=>' (block | assign_s | fexpr | decorator* cexpr) ;
cond@: bin@ | bin@ '?' assign ':' assign ;
bin@: unary@ | bin@ bop unary ;
%bin@: bin@ ('as' | 'satisfies') (type | 'const') ;
bop: BINARY | '&' | '|' | '<' | '>' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | 'in' | 'instanceof' | '>' '=' ;
-unary@: ('delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | INC | NLINC | 'await') unary | post@ ;
%unary@: ('delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | INC | NLINC | 'await') unary | post@ | '<' (type | 'const') '>' unary ;
post@: lhs@ | lhs@ INC ;
lhs@: primary@ | lhs@ '.' (word | PRIVATE) | lhs@ '?.' (word | PRIVATE | '[' expr ']' | '(' args? ')' | template) | lhs@ '[' expr ']' | lhs@ '(' args? ')' | lhs@ template | 'new' lhs ! | 'new' '.' 'target' | 'import' '(' args ')' | 'import' '.' word ;
%lhs@: lhs@ '!' | lhs@ targs '(' args? ')' | lhs@ '?.' targs '(' args? ')' | lhs@ targs template | lhs@ targs ! ;
args: {arg ','} ','? ;
arg: '...'? assign ;
primary: id | 'this' | 'super' | 'null' | 'true' | 'false' | NUMBER | STRING | REGEX | template | '(' expr ')' | array | object | fexpr | decorator* cexpr | PRIVATE ;
primary_s: id | 'this' | 'super' | 'null' | 'true' | 'false' | NUMBER | STRING | REGEX | template | '(' expr ')' | array ;
-cexpr: 'class' id? ('extends' lhs)? '{' member* '}' ;
%cexpr: 'class' id? tparams? ('extends' lhs)? ('implements' types)? '{' member* '}' ;
template: TEMPLATE | TSTART expr (TMID expr)* TEND ;
array: '[' ','* ']' | '[' ','* {arg sepc} ','* ']' ;
object: '{' ({prop ','} ','?)? '}' ;
prop: id | id '=' assign | pname ':' assign | '...' assign | omethod ;

%types: {type ','} ;
%ret: ':' (type | 'asserts'? (id | 'this') 'is' type | 'asserts' (id | 'this')) ;
%tparams: '<' {tparam ','} ','? '>' ;
%tparam: ('const' | 'in' | 'out')* id ('extends' type)? ('=' type)? ;
%targs: '<' {type ','} ','? '>' ;
%type: utype | ctype 'extends' type '?' type ':' type | 'new' tparams? '(' formals? ')' '=>' fret | 'abstract' 'new' tparams? '(' formals? ')' '=>' fret | tparams? '(' formals? ')' '=>' fret ;
%fret: type | 'asserts'? (id | 'this') 'is' type | 'asserts' (id | 'this') ;
%ctype: utype ;
%utype: ('|' | '&')? {ptype uop} ;
%uop: '|' | '&' ;
%ptype: ('keyof' | 'readonly' | 'unique') ptype | 'infer' id ('extends' utype)? | atype ;
%atype: qname targs? | 'this' | 'void' | 'null' | 'true' | 'false' | STRING | '-'? NUMBER | TEMPLATE | TSTART type (TMID type)* TEND | '(' type ')' | 'typeof' tquery targs? | 'import' '(' type (',' object)? ')' ('.' word)* targs? | '[' ({titem ','} ','?)? ']' | otype | mapped | atype SAMELINE type? ']' ;
%tquery: id | 'this' | 'import' '(' type ')' | tquery '.' (word | PRIVATE) ;
%titem: '...'? type | '...'? word '?'? ':' type | type '?' ;
%qname: id | qname '.' word ;
%otype: '{' ({tmember tsep} tsep?)? '}' ;
%tsep: ';' | ',' ;
%tmember: 'readonly'? pname '?'? (':' type)? | ('get' | 'set')? pname '?'? tparams? '(' formals? ')' ret? | 'new'? tparams? '(' formals? ')' ret? | 'readonly'? index ;
%index: '[' id ':' type ']' ':' type ;
%mapped: '{' (('+' | '-')? 'readonly')? '[' id 'in' type ('as' type)? ']' (('+' | '-')? '?')? (':' type)? ';'? '}' ;
%tdecl: iface | 'type' id tparams? '=' type ';' | enumd | 'declare' (var ';' | func | class | iface | enumd | space | 'type' id tparams? '=' type ';' | 'global' block_m | import) | space | 'global' block_m ;
%iface: 'interface' id tparams? ('extends' {iref ','})? otype ;
%iref: qname targs? ;
%enumd: 'const'? 'enum' id '{' ({emember ','} ','?)? '}' ;
%emember: pname ('=' assign)? ;
%space: ('namespace' | 'module') (qname | STRING) (block_m | ';') ;
%block_m: '{' item* '}' ;
"""
