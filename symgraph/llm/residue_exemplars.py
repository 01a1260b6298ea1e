"""Labelled exemplars of residue in place of content, and words of text that merely speaks of it.

They are written from what is public: the reason phrases of HTTP, the error
pages of common servers and browsers, notices for browsers without scripts,
lorem ipsum and its source, the syntax of template engines, the field names of
patent office forms. ``(a|b)`` stands for either; every combination is an
exemplar.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

#: The reason phrases of RFC 9110 and RFC 6585 for errors, and those of the usual proxies (fixed values).
REASONS = [
    "Bad Request", "Unauthorized", "Payment Required", "Forbidden", "Not Found", "Method Not Allowed", "Not Acceptable", "Proxy Authentication Required", "Request Timeout",
    "Conflict", "Gone", "Length Required", "Precondition Failed", "Content Too Large", "URI Too Long", "Unsupported Media Type", "Range Not Satisfiable", "Expectation Failed",
    "Misdirected Request", "Unprocessable Content", "Upgrade Required", "Too Many Requests", "Request Header Fields Too Large", "Internal Server Error", "Not Implemented",
    "Bad Gateway", "Service Unavailable", "Gateway Timeout", "Gateway Time-out", "HTTP Version Not Supported", "Web server is down", "Connection timed out", "Origin is unreachable", "Backend fetch failed",
]

_IT = "(page|document|file|resource|record|article|publication|text|full text|content|site|patent)"

ERROR = [
    *REASONS,
    *[f"Error {r}" for r in REASONS],
    *[f"HTTP Status {r}" for r in REASONS],
    *[f"HTTP Error {r}" for r in REASONS],
    *[f'{{"(error|errors)":{{"code":500,"message":"{r}","status":"error"}}}}' for r in REASONS],
    *[f"500 {r} 500 {r} nginx" for r in REASONS],
    "(Error|Fehler|Erreur|Error de servidor) 404", f"{_IT} not found", f"The requested (URL|address|{_IT[1:-1]}) was not found on this server.", f"The {_IT} you (requested|are looking for|were looking for|are trying to reach) (was not found|could not be found|cannot be found|does not exist|may have been moved)",
    f"(We|Sorry, we) (could not|can't|cannot|couldn't) find the {_IT} you (requested|are looking for|are trying to reach)", f"This {_IT} (does not exist|no longer exists|is not available|is no longer available|has been removed|has moved|has been deleted)",
    f"The (requested |){_IT} could not be (found|loaded|displayed|opened|retrieved|shown)", f"The (requested |){_IT} is (temporarily |currently |)(unavailable|not available)", f"(Failed|Unable) to (load|retrieve|open|display|fetch) the (requested |){_IT}", "Error loading (page|document|content)", f"{_IT} not available",
    "Go back to the (home page|search|start page|previous page|search page)", "Return to the (home page|search|start page|previous page)", "Please check the (URL|address|spelling) and try again", "It may have been moved or deleted",
    "Access (denied|forbidden|restricted)", f"You (do not|don't) have (permission|access|sufficient rights) to (access|view|open) this {_IT}", f"You are not (authorized|allowed|permitted) to (access|view|open) this {_IT}",
    "The (service|server|site|system|website) is (temporarily|currently) (unavailable|down|offline|overloaded|unreachable)", "The (service|server|site|system|website) is (temporarily |)down for (scheduled |)maintenance", "(Scheduled|Planned) maintenance in progress", "We'll be back (soon|shortly)", "(Sorry|We apologize|We are sorry) for the inconvenience",
    "Please try again (later|in a few minutes|in a moment|shortly|soon)", "Please (reload|refresh) (the|this) page", "Wait a few (minutes|seconds) and (reload|try again|refresh)",
    "(Sorry|We are sorry|Oops), something went wrong", "An (unexpected |internal |unknown |)error (has |)occurred", "An error (has |)occurred while (processing your request|loading the page|loading this document)", "Our (team|engineers) (has|have) been (notified|informed)", "The server encountered an (internal |)error (or misconfiguration |)and was unable to complete your request",
    "Your session has (expired|timed out|ended)", f"(Please |)(sign|log) in (again |)to (continue|view this {_IT}|access this {_IT})", f"(Login|Sign-in|Authentication|Subscription) required", "Invalid (session|token|request|credentials)",
    "(Too many|Rate limit exceeded, too many) requests from (your|this) (address|IP address|network)", "Unusual traffic from your (computer network|network|address)", "Please (complete|solve) the (captcha|security check)", "Search (failed|timed out)",
    "upstream connect error or disconnect/reset before headers", "Connection (refused|reset by peer|timed out|closed|lost)", "The (connection|request|server|query|search) (has |)timed out", "(Read|Connection) timed out while reading the response", "This site can't be reached", "(took|is taking) too long to respond", "no (healthy upstream|route to host)", "DNS_PROBE_FINISHED_NXDOMAIN", "ERR_CONNECTION_TIMED_OUT",
    "Traceback (most recent call last):", "Fatal error: Uncaught exception", "Exception in thread main", "NullPointerException", "(timeout|connection|value|key|runtime) error: timed out after 30 seconds while (reading|loading|fetching)", "Warning: Undefined variable", "Unhandled exception", "Stack trace:", "Segmentation fault", "Error establishing a database connection", "Server Error in '/' Application",
    "(Seite|Dokument|Datei|Veröffentlichung) nicht gefunden", "Die (angeforderte|gesuchte|gewünschte) (Seite|Datei|Veröffentlichung) (konnte nicht gefunden werden|wurde nicht gefunden|ist nicht vorhanden|existiert nicht|ist nicht verfügbar)", "Das (angeforderte|gesuchte|gewünschte) Dokument (konnte nicht gefunden werden|konnte nicht geladen werden|ist nicht vorhanden|existiert nicht|ist nicht verfügbar)",
    "Es ist ein (unerwarteter |interner |)Fehler aufgetreten", "Ein (unerwarteter |interner |)Fehler ist aufgetreten", "Bitte versuchen Sie es (später|in einigen Minuten) (erneut|noch einmal|wieder)", "Zugriff verweigert", "Der (Dienst|Server) ist (vorübergehend|derzeit|momentan) nicht (verfügbar|erreichbar)", "Ihre Sitzung ist abgelaufen", "Bitte melden Sie sich (erneut |)an", "Sie haben keine Berechtigung", "Interner Serverfehler", "Zeitüberschreitung der Verbindung", "(Wegen |)Wartungsarbeiten",
    "Page (introuvable|non trouvée)", "Document introuvable", "Le document demandé (n'existe pas|n'est plus disponible|est introuvable|n'a pas été trouvé)", "La page (demandée|que vous recherchez) (n'existe pas|n'existe plus|n'est plus disponible|est introuvable|n'a pas été trouvée)", "Le (service|serveur|site) est (momentanément|temporairement|actuellement) indisponible", "Une erreur (interne |inattendue |)(est survenue|s'est produite)", "Veuillez réessayer (plus tard|ultérieurement|dans quelques minutes)", "Accès (refusé|interdit|non autorisé)", "Votre session a expiré", "Veuillez vous (re|)connecter", "Erreur interne du serveur", "Délai d'attente dépassé", "(Site |Service |)en maintenance",
    "Página no encontrada", "Documento no encontrado", "(La página|El documento) (solicitada|solicitado) (no existe|no está disponible|no se encuentra disponible)", "No se (ha podido|pudo) (cargar|encontrar|abrir|mostrar) (la página|el documento) (solicitada|solicitado)", "Se ha producido un error (inesperado|interno|)", "Ha ocurrido un error", "(Inténtelo|Inténtalo|Vuelva a intentarlo) (de nuevo |)más tarde", "Acceso (denegado|prohibido)", "El (servicio|servidor|sitio) no está disponible (temporalmente|en este momento|)", "Su sesión ha (caducado|expirado)", "Error interno del servidor", "Tiempo de espera agotado", "En mantenimiento",
    "(お探しの|ご指定の|要求された)(ページ|文書|ファイル|公報)(は|が)見つかりません(でした|)", "(お探しの|ご指定の|要求された)(ページ|文書|ファイル|公報)は存在しません", "ページが見つかりません", "(予期しない|)エラーが発生しました", "しばらく(して|経って)から(もう一度|再度)(お試し|アクセスして|やり直して)ください", "アクセスが(拒否されました|禁止されています|集中しています)", "(現在|ただいま)サービスを(ご利用いただけません|停止しています)", "セッションの有効期限が切れました", "(もう一度|再度)ログインしてください", "(メンテナンス|メンテナンス作業)中です", "サーバー内部エラー", "接続がタイムアウトしました",
    "(您访问的|您请求的|请求的|该|)(页面|文件|文档|网页)(不存在|未找到|已被删除|已删除|无法显示|无法访问)", "找不到(该|)(页面|文件|网页)", "(服务器|系统)(繁忙|内部错误|错误|维护中|正在维护)", "(服务|网站)(暂时|暂)(不可用|无法访问)", "(请|)稍后(再试|重试|再访问)", "(拒绝访问|访问被拒绝|禁止访问|没有访问权限)", "会话已(过期|超时)", "请(重新|)登录", "(请求|连接)超时", "(发生|出现)(未知|)错误", "访问过于频繁",
    "(요청하신|찾으시는|요청한) (페이지|문서|파일)를 찾을 수 없습니다", "(페이지|문서|파일)가 존재하지 않습니다", "(알 수 없는 |)오류가 발생했습니다", "(잠시 후|나중에) 다시 (시도해|이용해|접속해) 주(십시오|세요|시기 바랍니다)", "접근이 (거부되었습니다|제한되었습니다)", "서비스를 (일시적으로 |현재 |)(사용|이용)할 수 없습니다", "세션이 만료되었습니다", "다시 로그인(해 주십시오|하세요)", "(서버 |시스템 )점검 중입니다", "내부 서버 오류", "연결 시간이 초과되었습니다",
]

_SITE = "(view this page|view this document|continue|use this site|display this page|run this app|access this site)"
SCRIPT = [
    f"(Please |)(enable|turn on|activate|allow) JavaScript to {_SITE}", "(Please |)(enable|turn on|activate|allow) JavaScript (and cookies |)in your browser (settings |)", "(Please |)(enable|turn on|activate) JavaScript and (reload|refresh) (the|this) page", "JavaScript is (disabled|turned off|not enabled|blocked) (in your browser|)", f"JavaScript (is|must be enabled|and cookies are) required to {_SITE}", "You need to (enable|allow|turn on) (JavaScript|scripts|cookies|scripts and cookies) (to run this app|to use this site|)",
    "(This|The) (site|page|application|website|app) (requires|needs) (JavaScript|scripts|scripting|cookies|JavaScript and cookies)", "(This|The) (site|page|application|website|app) (works best|does not work|will not work|doesn't work properly) without JavaScript (enabled|)", "Some (features|parts|functions) of this (site|page) (will not|may not|do not) work (properly |)without (JavaScript|scripts)", "Some (features|parts|functions) of (this|the) (site|page|application) (will not|may not|do not) work",
    "Your browser (does not support|doesn't support|has disabled|is blocking|has blocked) (JavaScript|scripts|scripting|cookies)", "We've detected that JavaScript is disabled in this browser", "Checking (if the site connection is secure|your browser before accessing|your browser)", "(Enable|Allow|Accept) (cookies|scripts|scripts and cookies|JavaScript and cookies) to (continue|proceed)", "(Scripts|Cookies|Scripts and cookies) (are|must be) (required|enabled|allowed)", "(Verifying|Verify) you are human", "Please (upgrade|update) your browser",
    "(Bitte |)(aktivieren|erlauben) Sie (JavaScript|Skripte|JavaScript und Cookies)(, um (diese Seite anzuzeigen|fortzufahren|dieses Dokument anzuzeigen)| in Ihrem Browser|)", "JavaScript ist (in Ihrem Browser |)(deaktiviert|nicht aktiviert|ausgeschaltet|erforderlich)", "Diese (Seite|Website|Anwendung) (benötigt|erfordert) (JavaScript|Skripte)", "Ihr Browser unterstützt (kein JavaScript|keine Skripte)",
    "(Veuillez |Vous devez |)activer (JavaScript|les scripts|JavaScript et les cookies) (pour (afficher ce document|afficher cette page|continuer|accéder au site)|dans votre navigateur|)", "JavaScript est (désactivé|nécessaire|requis) (dans votre navigateur|pour afficher cette page|)", "Ce site (nécessite|requiert) JavaScript", "Votre navigateur ne (supporte|prend) pas (en charge |)JavaScript",
    "(Por favor, |)(active|habilite|active usted) JavaScript (en su navegador|para continuar|para ver (esta página|este documento)|)", "(Es necesario|Debe|Necesita) (activar|habilitar) JavaScript (para ver (esta página|el documento|el texto)|en su navegador|)", "JavaScript está (desactivado|deshabilitado) (en su navegador|)", "Este sitio (requiere|necesita) JavaScript", "Su navegador no (admite|soporta) JavaScript",
    "(JavaScript|スクリプト|JavaScriptとCookie)を有効にして(ください|から再読み込みしてください)", "(このページ|このサイト|本サイト|この文書)を(表示|閲覧|利用)するには(JavaScript|スクリプト)(を有効にしてください|が必要です)", "(JavaScript|スクリプト)が無効(になっています|です)", "お使いのブラウザは(JavaScript|スクリプト)に対応していません",
    "请(在浏览器中|)(启用|开启|允许)(JavaScript|脚本|JavaScript和Cookie)(后(重新加载|刷新)页面|以继续|)", "(本网站|本页面|此页面)需要(启用|)(JavaScript|脚本)(支持|)", "您的浏览器(不支持|已禁用|禁用了)(JavaScript|脚本)", "(JavaScript|脚本)(已被禁用|未启用)",
    "(자바스크립트|JavaScript|스크립트)를 (켜|활성화해|허용해|사용하도록 설정해) 주(십시오|세요)", "(이 페이지|이 문서|이 사이트)를 (보려면|이용하려면|사용하려면) (자바스크립트|JavaScript|스크립트)를 (켜|활성화해|허용해) 주(십시오|세요)", "(자바스크립트|JavaScript|스크립트)가 (비활성화되어|꺼져) 있습니다", "브라우저가 (자바스크립트|JavaScript|스크립트)를 지원하지 않습니다",
]

FILLER = [
    "(Text|Content|Copy|Description|Details|Caption|Abstract) (goes here|to follow|to come|to be added|to be added later|will follow|coming soon)", "(Your|Insert|Enter|Add|Put|Type) (your |)(text|content|description|abstract|title) here", "This is (a |)(sample|dummy|placeholder|filler|test|example) (text|document|content|paragraph)", "(Sample|Dummy|Placeholder|Filler|Test|Example) (text|document|content|paragraph)", "(Please |)replace (this|it|this text) with (your own text|the actual text|the real text|the description|the abstract|real content)",
    "TODO:? (write|add|complete|fill in) (the |)(detailed |)(text|description|abstract|content|claims|details)", "(To be determined|To be completed|To be announced|TBD|TBA|FIXME)", "asdf", "asdf jkl", "qwerty", "asdfghjkl", "foo bar baz", "blah blah", "The quick brown fox jumps over the lazy dog", "test test test", "Hello world",
    "(Blindtext|Platzhaltertext|Mustertext|Beispieltext|Dummytext)", "(Hier steht|Hier folgt|Hier kommt) (der|Ihr) Text", "Text (folgt|einfügen|wird nachgereicht|wird ergänzt)", "Dies ist ein (Blindtext|Platzhalter|Beispieltext|Testdokument|Typoblindtext)",
    "(Texte|Contenu) (d'exemple|fictif|à venir|à remplacer|à compléter|de remplissage|factice)", "(Votre|Insérez votre|Saisissez votre) texte ici", "Ceci est un (texte|document) (d'exemple|fictif|de test|de remplissage)", "faux texte", "(Texto|Contenido) (de ejemplo|de relleno|de prueba|ficticio|por definir)", "(Su|Inserte su|Escriba su|Escriba aquí su) texto aquí", "Este es un (texto|documento) de (ejemplo|prueba|relleno)",
    "(ダミー|サンプル)(テキスト|文章)(です|)", "(ここに|こちらに)(本文|テキスト|文章|説明)を(入力|記入|挿入)(してください|)", "これは(ダミー|サンプル|テスト)(テキスト|文章|文書)です", "(此处|在此|请在此)(填写|输入|插入|添加)(文本|内容|正文|说明|摘要)(内容|)", "(示例|占位|测试|样例)(文本|文字|内容|文档)", "(待补充|内容待定|待填写|待定)", "(여기에|이곳에) (내용|본문|텍스트|설명)을 (입력|작성)(하십시오|하세요|해 주십시오)", "(예시|샘플|더미|테스트) (텍스트|문서|글)(입니다|)", "(내용|본문)은 추후 (추가|입력) 예정입니다",
]

#: Filler whose words come in any order: lorem ipsum, the passages of De finibus bonorum et malorum (1.10.32, 33) that it is
#: made of, and the further Latin words that generators use; a window counts by the share of it that these words cover.
FILLER_WORDS = [
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto beatae vitae dicta "
    "explicabo nemo ipsam quia voluptas aspernatur aut odit fugit consequuntur magni dolores eos ratione sequi nesciunt neque porro quisquam dolorem numquam eius modi tempora incidunt magnam "
    "quaerat minima nostrum ullam corporis suscipit laboriosam nihil molestiae consequatur vel illum quo at vero accusamus iusto odio dignissimos ducimus blanditiis praesentium voluptatum deleniti "
    "atque corrupti quos quas molestias excepturi cupiditate provident similique mollitia animi dolorum fuga harum quidem rerum facilis expedita distinctio nam libero tempore cum soluta nobis "
    "eligendi optio cumque impedit minus quod maxime placeat facere possimus assumenda repellendus temporibus autem quibusdam officiis debitis necessitatibus saepe eveniet voluptates repudiandae "
    "recusandae itaque earum hic tenetur a sapiente delectus reiciendis voluptatibus maiores alias perferendis doloribus asperiores repellat "
    "vestibulum pellentesque curabitur praesent vivamus suspendisse phasellus aenean maecenas quisque nullam integer donec mauris morbi etiam fusce proin cras sollicitudin ultricies ultrices "
    "venenatis vehicula tristique tortor tellus tincidunt sodales semper sagittis rutrum rhoncus pulvinar purus posuere porttitor pharetra pretium ornare orci nunc nibh nec mattis massa luctus "
    "ligula lectus lacus lacinia justo interdum imperdiet iaculis hendrerit gravida fringilla feugiat felis faucibus facilisis euismod eros erat elementum egestas dictum diam dapibus cursus "
    "congue condimentum commodo blandit bibendum augue arcu ante aliquet aliquam accumsan ac volutpat viverra vulputate varius urna turpis tempus sem sapien risus quam placerat",
]

#: What stands in the brackets of an unfilled template part: field names of patent forms (as the INID codes have them) and of forms in general ...
_FIELD = "title|title of the invention|invention title|abstract|description|summary|background|field of the invention|claim|claims|drawings|figure|figure number|reference|reference numeral|reference sign|applicant|applicant name|name of applicant|inventor|inventor name|name of inventor|assignee|agent|attorney|attorney docket number|docket number|docket|application number|publication number|patent number|priority date|priority number|filing date|publication date|country|classification|ipc|company|company name|name|first name|last name|user name|address|email|phone|city|date|year|number|signature|author|text|content|body|value|keyword|keywords"
_DE = "Titel|Bezeichnung|Bezeichnung der Erfindung|Titel der Erfindung|Zusammenfassung|Beschreibung|Anspruch|Ansprüche|Anmelder|Name des Anmelders|Erfinder|Vertreter|Aktenzeichen|Anmeldetag|Prioritätsdatum|Datum|Name|Figur|Bezugszeichen"
_FR = "titre|titre de l'invention|abrégé|résumé|revendication|revendications|demandeur|nom du demandeur|déposant|inventeur|mandataire|numéro de dépôt|date de dépôt|date de priorité|texte|nom"
_ES = "título|título de la invención|resumen|descripción|reivindicación|reivindicaciones|solicitante|nombre del solicitante|inventor|representante|agente|número de solicitud|fecha de presentación|fecha de prioridad|fecha|texto|nombre|figura"
_JA = "発明の名称|名称|要約|要約書|請求項|明細書|出願人|発明者|代理人|出願番号|出願日|優先日|図面|氏名|住所|日付"
_ZH = "发明名称|名称|摘要|说明书|权利要求|权利要求书|申请人|发明人|代理人|申请号|申请日|优先权日|附图|姓名|地址|日期"
_KO = "발명의 명칭|명칭|요약|요약서|청구항|명세서|출원인|발명자|대리인|출원번호|출원일|우선일|도면|성명|주소|날짜"
NAMES = [f"({x})" for x in (_FIELD, _DE, _FR, _ES, _JA, _ZH, _KO)]
#: ... and demands to fill in, which are known in any kind of brackets.
DEMANDS = [
    f"(insert|enter|add|type|fill in|your|please insert|please enter|please add) ({_FIELD}) (here|)", f"({_FIELD}) (to be added|to be inserted|to be completed|to be filled in|to be determined|to be defined|missing|tbd)", "(tbd|tba|todo|to be determined|to be completed|to be filled in|to be added|to be defined|fill in|insert here|placeholder|insert placeholder|missing)",
    f"({_DE}|Text) (einfügen|ergänzen|eintragen|ausfüllen|fehlt|hier einfügen)", "(bitte |)(ausfüllen|ergänzen|einfügen|eintragen)", f"({_FR}|description|figure) (à compléter|à remplir|à insérer)", f"(insérer|saisir|ajouter|compléter) (le |la |l'|)({_FR}|description|figure)( ici|)", "à (compléter|remplir|insérer)",
    f"({_ES}) (por completar|por rellenar|a completar)", f"(insertar|introducir|añadir|rellenar|completar) (el |la |)({_ES})( aquí|)", "por (completar|rellenar|definir)", f"({_JA})(を記入|を入力|記入|入力|未記入)", "(ここに|)(記入|入力|挿入)(してください|)", f"({_ZH})(待填|待填写|填写|未填)", "(请|)(填写|填入|输入|插入)", f"({_KO})(을 입력|를 입력| 입력| 기입| 미기입)", "(입력|기입|작성)(하십시오|하세요| 필요|)",
]

#: Shapes that are template parts by themselves: the syntax of template engines, and date masks; see ``residue.parts``.
SHAPES = [
    "{{ name }}", "{% name %}", "<% name %>", "[% name %]", "<? name ?>", "${ name }", "#{ name }", "{$ name }", "[[ name ]]", "<< name >>", "@@ name @@", "%% name %%", "« MERGEFIELD name »",
    "DD/MM/YYYY", "MM/DD/YYYY", "YYYY-MM-DD", "TT.MM.JJJJ", "JJ/MM/AAAA", "DD/MM/AAAA", "XX/XX/XXXX", "dd-mm-yyyy",
]

#: Filler by its shape: one word over and over.
REPEATS = ["word word word"]

#: Words of sentences whose subject is placeholders, forms or messages.
MENTION = """placeholder placeholders template templates variable variables tag tags token tokens marker markers delimiter delimiters syntax parser parse parses generator engine renderer rendering render renders
replaced replaces replace substituted substitutes substitute substitution fills filled expands expanded expression expressions displayed displays field fields form forms key button screen user presses shown shows
string strings attribute element markup bracket brackets braces symbol identifier
platzhalter vorlage vorlagen variable variablen marke feld felder formular ersetzt ersetzen ausgefüllt ausfüllt generator parser zeichenkette angezeigt taste bildschirm schablone eingesetzt
modèle modèles gabarit variable variables balise balises champ champs formulaire remplacé remplacée remplace remplit espace réservé fictif générateur analyseur affiché écran touche
plantilla plantillas variable variables etiqueta marcador marcadores campo campos formulario sustituye sustituido reemplaza reemplazado rellena generador analizador pantalla tecla muestra
プレースホルダ プレースホルダー テンプレート 変数 タグ フィールド フォーム 置き換え 置換 生成 構文解析 表示 キー 画面
占位符 模板 变量 标签 字段 表单 替换 生成器 解析 显示 屏幕 按键
자리표시자 표시자 템플릿 변수 태그 필드 양식 대체 치환 생성기 파서 화면 버튼"""


def expand(family: str) -> Iterator[str]:
    """Every text that a family with ``(a|b)`` stands for; brackets inside brackets are expanded first."""
    pieces, depth, at = [], 0, 0
    for i, c in enumerate(family):
        if c == "(":
            if not depth:
                pieces.append([family[at:i]])
                at = i + 1
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                pieces.append([x for part in _split(family[at:i]) for x in expand(part)])
                at = i + 1
    pieces.append([family[at:]])
    return ("".join(p) for p in product(*pieces))


def _split(inner: str) -> list[str]:
    out, depth = [""], 0
    for c in inner:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out
