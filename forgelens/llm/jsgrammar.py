"""A recogniser for JavaScript as a script (ECMAScript 2024): ``check(text)`` raises ``JsSyntaxError``.

Recursive descent over tokens scanned on demand, because only the parser knows whether a slash
starts a regular expression. Expressions give small tuples, enough to tell assignment targets and
arrow parameters from other expressions. Besides the grammar it knows the early errors that engines
report while parsing: illegal return, break, continue and labels, names declared twice, invalid
assignment targets, and the restrictions of strict mode.
"""

from __future__ import annotations

import re

RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if "
    "import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
STRICT_RESERVED = frozenset("implements interface let package private protected public static yield".split())
BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8,
    "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
IDENT = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|[$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
SPACE = re.compile(r"(?:[ \t\v\f\u00a0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000\r\n\u2028\u2029]+|//[^\r\n\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/)+")
HTML_COMMENT = re.compile(r"<!--[^\r\n\u2028\u2029]*")
HTML_CLOSE = re.compile(r"-->[^\r\n\u2028\u2029]*")
NEWLINE = re.compile(r"[\r\n\u2028\u2029]")
TOKEN = re.compile(
    rf"(?P<n>{IDENT})"
    r"|(?P<d>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?"
    r"|(?:0|[1-9](?:_?\d)*)n|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|0\d+(?:\.\d*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)"
    r"|(?P<s>'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\")"
    r"|(?P<p>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@`])"
    rf"|(?P<h>\#{IDENT})"
)
TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n\u2028\u2029]|\\[^\r\n\u2028\u2029]|\[(?:[^\]\\\r\n\u2028\u2029]|\\[^\r\n\u2028\u2029])*\])+/")
FLAGS = re.compile(r"[\w$]*")
BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))")
OCTAL_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:[1-9]|0\d)")

OTHER = ("other",)


class JsSyntaxError(SyntaxError):
    pass


class Scope:
    __slots__ = ("lexical", "variables", "function", "parent", "params")

    def __init__(self, parent: Scope | None, function: bool) -> None:
        self.lexical: set[str] = set()
        self.variables: set[str] = set()
        self.params: set[str] = set()
        self.function, self.parent = function, parent


class Parser:
    def __init__(self, text: str) -> None:
        self.text, self.pos, self.end = text, 0, len(text)
        if text.startswith("#!"):
            m = NEWLINE.search(text)
            self.pos = m.start() if m else self.end
        self.strict = self.in_function = self.is_async = self.is_generator = False
        self.may_super = self.in_class_field = False
        self.loops = self.switches = 0
        self.labels: list[tuple[str, bool]] = []
        self.scope = Scope(None, True)
        self.kind = self.value = ""
        self.newline, self.start, self.last = False, 0, 0
        self.cover: list[int] = []
        self.advance()

    def fail(self, why: str = "unexpected token") -> None:
        raise JsSyntaxError(f"{why} {self.value[:20]!r} at {self.start}")

    def advance(self) -> None:
        text, pos = self.text, self.pos
        self.last = pos
        self.newline = pos == 0
        while True:
            m = SPACE.match(text, pos)
            if m:
                if not self.newline and NEWLINE.search(text, pos, m.end()):
                    self.newline = True
                pos = m.end()
            if text.startswith("<!--", pos):
                pos = HTML_COMMENT.match(text, pos).end()
            elif self.newline and text.startswith("-->", pos):
                pos = HTML_CLOSE.match(text, pos).end()
            else:
                break
        self.start = pos
        if pos >= self.end:
            self.kind = self.value = "eof"
            self.pos = pos
            return
        m = TOKEN.match(text, pos)
        if not m:
            self.kind, self.value = "?", text[pos]
            self.fail("unknown character")
        self.kind, self.value, self.pos = m.lastgroup, m.group(), m.end()
        if self.kind == "n":
            if "\\" in self.value:
                self.value = re.sub(r"\\u(?:\{([^}]+)\}|(....))", lambda x: chr(int(x[1] or x[2], 16)), self.value)
                self.kind = "n" if self.value not in RESERVED else "escaped"
        elif self.kind == "d":
            if self.pos < self.end and (text[self.pos].isalnum() or text[self.pos] in "$_\\"):
                self.fail("bad number")
            if self.strict and len(self.value) > 1 and self.value[0] == "0" and self.value[1].isdigit():
                self.fail("octal number in strict mode")
        elif self.kind == "s" and "\\" in self.value:
            if BAD_ESCAPE.search(self.value) or self.strict and OCTAL_ESCAPE.search(self.value):
                self.fail("bad escape")

    def at(self, value: str) -> bool:
        return self.value == value and (self.kind == "p" or self.kind == "n")

    def eat(self, value: str) -> bool:
        if self.value == value and (self.kind == "p" or self.kind == "n"):
            self.advance()
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.eat(value):
            self.fail(f"expected {value}, found")

    def semicolon(self) -> None:
        if self.eat(";") or self.at("}") or self.kind == "eof" or self.newline:
            return
        self.fail()

    def peek(self) -> tuple[str, str, bool]:
        """Kind, value and newline of the token after this one."""
        saved = self.kind, self.value, self.newline, self.start, self.pos, self.last
        try:
            self.advance()
            return self.kind, self.value, self.newline
        except JsSyntaxError:
            return "?", "", False
        finally:
            self.kind, self.value, self.newline, self.start, self.pos, self.last = saved

    # names and scopes

    def name_ok(self, name: str) -> bool:
        if name in RESERVED or name == "await" and (self.is_async or self.in_class_field) or name == "yield" and (self.is_generator or self.strict):
            return False
        return not (self.strict and name in STRICT_RESERVED)

    def binding_name(self) -> str:
        name = self.value
        if self.kind != "n" or not self.name_ok(name):
            self.fail("expected a name, found")
        if self.strict and name in ("eval", "arguments"):
            self.fail("restricted name")
        self.advance()
        return name

    def declare(self, name: str, how: str) -> None:
        s = self.scope
        if how == "var":
            while True:
                if name in s.lexical:
                    self.fail(f"{name} declared twice;")
                s.variables.add(name)
                if s.function:
                    return
                s = s.parent
        elif how == "function" and s.function:
            if name in s.lexical:
                self.fail(f"{name} declared twice;")
            s.variables.add(name)
        elif how == "function" and not self.strict:
            if name in s.variables and name not in s.params or name in s.lexical and name not in s.params:
                self.fail(f"{name} declared twice;")
            s.lexical.add(name)
            s.params.add(name)  # sloppy blocks may repeat functions
        else:
            if name in s.lexical or name in s.variables or name in s.params:
                self.fail(f"{name} declared twice;")
            if name == "let" and how in ("let", "const", "class"):
                self.fail("let is no lexical name")
            s.lexical.add(name)

    def binding(self, names: list[str]) -> None:
        """A binding name or pattern; its names are added to ``names``."""
        if self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                rest = self.eat("...")
                self.binding(names)
                if not rest and self.eat("="):
                    self.assignment()
                if not self.at("]"):
                    if rest:
                        self.fail()
                    self.expect(",")
        elif self.eat("{"):
            while not self.eat("}"):
                if self.eat("..."):
                    names.append(self.binding_name())
                    if not self.at("}"):
                        self.fail()
                else:
                    plain = self.kind == "n"
                    name = self.value
                    self.property_name()
                    if self.eat(":"):
                        self.binding(names)
                    elif not plain or not self.name_ok(name) or self.strict and name in ("eval", "arguments"):
                        self.fail()
                    else:
                        names.append(name)
                    if self.eat("="):
                        self.assignment()
                if not self.at("}"):
                    self.expect(",")
        else:
            names.append(self.binding_name())

    # statements

    def program(self) -> None:
        self.directives()
        while self.kind != "eof":
            self.statement(True)

    def directives(self) -> bool:
        while self.kind == "s":
            raw = self.value
            kind, value, newline = self.peek()
            ends = value in (";", "}") and kind == "p" or kind == "eof" or newline and not (kind == "p" and value in ("(", "[", ".", ",", "?", "`", "=", "+", "-", "*", "/", "&&", "||", "?.") or value in ("in", "instanceof"))
            if not ends:
                return False
            if raw[1:-1] == "use strict":
                self.strict = True
            self.advance()
            self.semicolon()
        return self.strict

    def block(self) -> None:
        self.expect("{")
        self.scope = Scope(self.scope, False)
        while not self.eat("}"):
            if self.kind == "eof":
                self.fail("unclosed block")
            self.statement(True)
        self.scope = self.scope.parent

    def statement(self, declarations: bool = False) -> None:
        v, k = self.value, self.kind
        if k == "p":
            if v == "{":
                return self.block()
            if v == ";":
                return self.advance()
        elif k == "n":
            handler = STATEMENTS.get(v)
            if handler:
                return handler(self, declarations)
            if v == "async" and not self.text.startswith("\\", self.start):
                kind, value, newline = self.peek()
                if kind == "n" and value == "function" and not newline:
                    if not declarations:
                        self.fail()
                    return self.function_declaration(declarations)
            if v == "let":
                kind, value, newline = self.peek()
                if (kind == "n" and value not in ("in", "instanceof", "of") and (declarations or not newline)) or value in ("[", "{") and kind == "p" or kind == "n" and value == "of" and declarations:
                    if not declarations:
                        self.fail()
                    return self.variables("let")
            kind, value, _ = self.peek()
            if kind == "p" and value == ":":
                return self.labelled(declarations)
        self.expression_statement()

    def expression_statement(self) -> None:
        self.expression()
        self.semicolon()

    def labelled(self, declarations: bool) -> None:
        name = self.binding_name()
        self.expect(":")
        if any(x == name for x, _ in self.labels):
            self.fail("label used twice")
        ahead = self.value if self.kind == "n" else ""
        self.labels.append((name, ahead in ("for", "while", "do")))
        if ahead == "function":
            if self.strict:
                self.fail()
            self.function_declaration(True)
        else:
            self.statement(False)
        self.labels.pop()

    def variables(self, how: str, in_for: bool = False) -> tuple[int, bool]:
        """Declarations; in a for head without the final semicolon. Gives their number and whether one has a value."""
        self.advance()
        count, valued = 0, False
        while True:
            pattern = self.at("[") or self.at("{")
            names: list[str] = []
            self.binding(names)
            for n in names:
                self.declare(n, how)
            count += 1
            if self.eat("="):
                self.assignment(not in_for)
                valued = True
            elif not in_for and (pattern or how == "const"):
                self.fail("missing value")
            elif in_for and (pattern or how == "const") and not (self.at("in") or self.at("of")):
                self.fail("missing value")
            if not self.eat(","):
                break
        if not in_for:
            self.semicolon()
        return count, valued

    def s_var(self, declarations: bool) -> None:
        self.variables("var")

    def s_const(self, declarations: bool) -> None:
        if not declarations:
            self.fail()
        self.variables("const")

    def function_declaration(self, declarations: bool) -> None:
        if not declarations:
            self.fail()
        self.function(True)

    def s_class(self, declarations: bool) -> None:
        if not declarations:
            self.fail()
        self.class_(True)

    def condition(self) -> None:
        self.expect("(")
        self.expression()
        self.expect(")")

    def sub(self) -> None:
        if self.at("function") and not self.strict:
            self.scope = Scope(self.scope, False)
            self.function_declaration(True)
            self.scope = self.scope.parent
        else:
            self.statement(False)

    def s_if(self, declarations: bool) -> None:
        self.advance()
        self.condition()
        self.sub()
        if self.eat("else"):
            self.sub()

    def loop_body(self) -> None:
        self.loops += 1
        self.statement(False)
        self.loops -= 1

    def s_while(self, declarations: bool) -> None:
        self.advance()
        self.condition()
        self.loop_body()

    def s_do(self, declarations: bool) -> None:
        self.advance()
        self.loop_body()
        self.expect("while")
        self.condition()
        self.eat(";")

    def s_for(self, declarations: bool) -> None:
        self.advance()
        waits = False
        if self.at("await"):
            if not self.is_async:
                self.fail()
            waits = True
            self.advance()
        self.expect("(")
        self.scope = Scope(self.scope, False)
        how = self.value if self.kind == "n" and self.value in ("var", "const") else ""
        if self.at("let"):
            kind, value, _ = self.peek()
            if kind == "n" and value not in ("in", "of") or value in ("[", "{"):
                how = "let"
        if how:
            count, valued = self.variables(how, True)
            if self.at("of") or self.at("in"):
                if count != 1 or valued and (self.at("of") or self.strict or how != "var"):
                    self.fail()
                self.each(waits)
            else:
                self.three()
        elif self.at(";"):
            self.three()
        else:
            async_of = self.at("async") and self.peek()[:2] == ("n", "of")
            mark = len(self.cover)
            left = self.expression(False)
            if self.at("of") or self.at("in"):
                if async_of and not waits and left == ("id", "async"):
                    self.fail()
                del self.cover[mark:]
                self.target(left, True)
                self.each(waits)
            else:
                self.covered(mark)
                self.three()
        self.expect(")")
        self.loop_body()
        self.scope = self.scope.parent

    def each(self, waits: bool) -> None:
        if self.eat("of"):
            self.assignment()
        else:
            if waits:
                self.fail()
            self.advance()
            self.expression()

    def three(self) -> None:
        self.expect(";")
        if not self.at(";"):
            self.expression()
        self.expect(";")
        if not self.at(")"):
            self.expression()

    def s_jump(self, declarations: bool) -> None:
        word = self.value
        self.advance()
        if self.kind == "n" and not self.newline and self.value not in RESERVED:
            known = [loop for name, loop in self.labels if name == self.value]
            if not known or word == "continue" and not known[0]:
                self.fail("unknown label")
            self.advance()
        elif not (self.loops or word == "break" and self.switches):
            self.fail(f"illegal {word}")
        self.semicolon()

    def s_return(self, declarations: bool) -> None:
        if not self.in_function:
            self.fail("illegal return")
        self.advance()
        if not (self.at(";") or self.at("}") or self.kind == "eof" or self.newline):
            self.expression()
        self.semicolon()

    def s_with(self, declarations: bool) -> None:
        if self.strict:
            self.fail()
        self.advance()
        self.condition()
        self.statement(False)

    def s_switch(self, declarations: bool) -> None:
        self.advance()
        self.condition()
        self.expect("{")
        self.scope = Scope(self.scope, False)
        self.switches += 1
        default = False
        while not self.eat("}"):
            if self.eat("case"):
                self.expression()
            else:
                if default:
                    self.fail("two defaults")
                default = True
                self.expect("default")
            self.expect(":")
            while not (self.at("case") or self.at("default") or self.at("}")):
                if self.kind == "eof":
                    self.fail("unclosed switch")
                self.statement(True)
        self.switches -= 1
        self.scope = self.scope.parent

    def s_throw(self, declarations: bool) -> None:
        self.advance()
        if self.newline:
            self.fail("newline after throw")
        self.expression()
        self.semicolon()

    def s_try(self, declarations: bool) -> None:
        self.advance()
        self.block()
        caught = self.eat("catch")
        if caught:
            self.scope = Scope(self.scope, False)
            if self.eat("("):
                names: list[str] = []
                self.binding(names)
                if len(set(names)) != len(names):
                    self.fail("name declared twice")
                self.expect(")")
            self.block()
            self.scope = self.scope.parent
        if self.eat("finally"):
            self.block()
        elif not caught:
            self.fail("try without catch")

    def s_debugger(self, declarations: bool) -> None:
        self.advance()
        self.semicolon()

    def s_import(self, declarations: bool) -> None:
        if self.peek()[1] != "(":
            self.fail("module syntax in a script")
        self.expression_statement()

    # functions and classes

    def function(self, declaration: bool) -> None:
        is_async = self.eat("async")
        self.expect("function")
        generator = self.eat("*")
        if declaration:
            name = self.binding_name()
            self.declare(name, "function" if not (is_async or generator) or self.scope.function else "let")
        elif self.kind == "n" and not self.at("("):
            saved = self.is_async, self.is_generator
            self.is_async, self.is_generator = is_async, generator
            self.binding_name()
            self.is_async, self.is_generator = saved
        self.function_rest(is_async, generator)

    def function_rest(self, is_async: bool, generator: bool, method: bool = False, arrow_params: list[str] | None = None) -> None:
        """Parameters and body; with ``arrow_params`` the body of an arrow whose parameters are read."""
        saved = self.strict, self.in_function, self.is_async, self.is_generator, self.may_super, self.loops, self.switches, self.labels, self.scope, self.in_class_field
        arrow = arrow_params is not None
        self.in_class_field = self.in_class_field and arrow
        self.is_async, self.is_generator, self.loops, self.switches, self.labels = is_async, generator, 0, 0, []
        if not arrow:
            self.may_super = method
        self.scope = Scope(self.scope, True)
        names: list[str] = arrow_params or []
        simple = not arrow
        if not arrow:
            self.in_function = True
            self.expect("(")
            while not self.eat(")"):
                rest = self.eat("...")
                simple = simple and not rest and self.kind == "n"
                self.binding(names)
                if not rest and self.eat("="):
                    simple = False
                    self.assignment()
                if not self.at(")"):
                    if rest:
                        self.fail()
                    self.expect(",")
        self.scope.params.update(names)
        if arrow and not self.at("{"):
            self.in_function_expression_body(names)
        else:
            self.in_function = True
            self.expect("{")
            own = self.directives() and not saved[0]
            if own and not simple and not arrow:
                self.fail("use strict with other than simple parameters")
            if self.strict and any(n in STRICT_RESERVED or n in ("eval", "arguments") for n in names):
                self.fail("restricted name")
            while not self.at("}"):
                if self.kind == "eof":
                    self.fail("unclosed function")
                self.statement(True)
        if (self.strict or arrow or method or not simple) and len(set(names)) != len(names):
            self.fail("parameter named twice")
        closing = self.at("}") and not (arrow and self.expression_body)
        (self.strict, self.in_function, self.is_async, self.is_generator, self.may_super, self.loops, self.switches, self.labels, self.scope, self.in_class_field) = saved
        if closing:
            self.advance()

    expression_body = False

    def in_function_expression_body(self, names: list[str]) -> None:
        self.assignment(self.arrow_in)
        self.expression_body = True

    arrow_in = True

    def arrow(self, params: list[str], is_async: bool, allow_in: bool) -> tuple:
        if self.newline:
            self.fail("newline before arrow")
        self.expect("=>")
        self.arrow_in, before = allow_in, self.arrow_in
        self.expression_body = False
        generator = self.is_generator
        self.function_rest(is_async, False, arrow_params=params)
        self.is_generator, self.arrow_in, self.expression_body = generator, before, False
        return ("arrow",)

    def class_(self, declaration: bool) -> None:
        strict, self.strict = self.strict, True
        self.advance()
        if self.kind == "n" and not self.at("extends"):
            name = self.binding_name()
            if declaration:
                self.declare(name, "class")
        elif declaration:
            self.fail("class without a name")
        if self.eat("extends"):
            self.unary_tail()
        self.expect("{")
        constructors = 0
        while not self.eat("}"):
            if not self.eat(";"):
                constructors += self.member(True)
                if constructors > 1:
                    self.fail("two constructors")
        self.strict = strict

    def property_name(self) -> str:
        name = self.value
        if self.kind in ("n", "s", "d", "escaped"):
            self.advance()
        elif self.eat("["):
            self.assignment()
            self.expect("]")
            name = "[]"
        elif self.kind == "h":
            self.advance()
        else:
            self.fail()
        return name

    def member(self, in_class: bool) -> int:
        """A class member; 1 for a constructor."""
        static = False
        if self.at("static"):
            kind, value, _ = self.peek()
            if value == "{" and kind == "p":
                self.advance()
                saved = self.in_function, self.may_super, self.is_async, self.is_generator, self.loops, self.switches, self.labels
                self.in_function, self.may_super, self.is_async, self.is_generator, self.loops, self.switches, self.labels = False, True, False, False, 0, 0, []
                self.scope = Scope(self.scope, True)
                self.block()
                self.scope = self.scope.parent
                self.in_function, self.may_super, self.is_async, self.is_generator, self.loops, self.switches, self.labels = saved
                return 0
            if not (kind == "p" and value in ("(", "=", ";", "}")):
                static = True
                self.advance()
        is_async = generator = accessor = False
        if self.at("async"):
            kind, value, newline = self.peek()
            if not newline and not (kind == "p" and value in ("(", "=", ";", "}")):
                is_async = True
                self.advance()
        if self.eat("*"):
            generator = True
        if (self.at("get") or self.at("set")) and not is_async and not generator:
            kind, value, newline = self.peek()
            if not (kind == "p" and value in ("(", "=", ";", "}", "*")) and kind != "eof":
                accessor = True
                self.advance()
        quoted = self.kind in ("n", "s")
        name = self.property_name().strip("'\"")
        if self.at("("):
            self.function_rest(is_async, generator, True)
            return int(quoted and name == "constructor" and not static)
        if is_async or generator or accessor:
            self.fail()
        if self.eat("="):
            saved = self.may_super, self.in_class_field, self.in_function
            self.may_super, self.in_class_field = True, True
            self.scope = Scope(self.scope, True)
            self.assignment()
            self.scope = self.scope.parent
            self.may_super, self.in_class_field, self.in_function = saved
        self.semicolon()
        return 0

    # expressions

    def covered(self, mark: int) -> None:
        """Raise for `{a = 1}` that turned out to be no pattern."""
        if len(self.cover) > mark:
            self.fail("shorthand value outside a pattern")

    def expression(self, allow_in: bool = True) -> tuple:
        mark = len(self.cover)
        e = self.assignment(allow_in, True)
        if self.at(","):
            while self.eat(","):
                self.assignment(allow_in)
            e = OTHER
        if allow_in:
            self.covered(mark)
        return e

    def assignment(self, allow_in: bool = True, cover: bool = False) -> tuple:
        mark = len(self.cover)
        if self.kind == "n":
            v = self.value
            if v == "yield" and self.is_generator:
                self.advance()
                if not self.newline:
                    if self.eat("*"):
                        self.assignment(allow_in)
                    elif not (self.kind == "eof" or self.kind == "p" and self.value in (")", "]", "}", ",", ";", ":") or self.value in ("in", "of") and self.kind == "n"):
                        self.assignment(allow_in)
                return OTHER
            if v == "async":
                kind, value, newline = self.peek()
                if kind == "n" and not newline and value not in RESERVED and value not in ("of",):
                    self.advance()
                    name = self.value
                    if self.peek()[1] != "=>" or name == "await":
                        self.fail()
                    self.advance()
                    return self.arrow([name], True, allow_in)
            elif v not in RESERVED and self.text.startswith("=>", self.pos + (1 if self.text[self.pos:self.pos + 1] == " " else 0)):
                name = self.binding_name()
                if self.at("=>"):
                    return self.arrow([name], False, allow_in)
                self.fail()
        e = self.conditional(allow_in)
        if self.kind != "p":
            if not cover:
                self.covered(mark)
            return e
        if self.value == "=>":
            if e[0] == "params":
                del self.cover[mark:]
                names: list[str] = []
                for x in e[1]:
                    self.parameter(x, names)
                return self.arrow(names, e[2], allow_in)
            if e[0] == "id" and self.name_ok(e[1]):
                return self.arrow([e[1]], False, allow_in)
            self.fail()
        if e[0] == "params":
            if e[2] is False:
                if e[3]:
                    self.fail("parameters without an arrow")
                e = ("paren", e[1][0])
            else:
                e = ("call",)
        if self.value in ASSIGN:
            if self.value == "=":
                del self.cover[mark:]
                self.target(e, True)
            else:
                self.target(e, False)
            self.advance()
            self.assignment(allow_in)
            return ("assign", e)
        if not cover:
            self.covered(mark)
        return e

    def target(self, e: tuple, patterns: bool) -> None:
        kind = e[0]
        if kind == "member":
            return
        if kind == "id":
            if not self.name_ok(e[1]) or self.strict and e[1] in ("eval", "arguments"):
                self.fail("restricted name")
            return
        if kind == "paren":
            if e[1][0] in ("id", "member", "paren"):
                return self.target(e[1], False)
        if kind == "call" and not self.strict:
            return  # an error only when it runs
        if patterns and kind in ("object", "array"):
            for i, x in enumerate(e[1]):
                if x[0] == "spread":
                    if i != len(e[1]) - 1 or x[1][0] == "assign" or kind == "array" and e[2]:
                        self.fail("bad rest")
                    x = x[1]
                if x[0] == "assign":
                    x = x[1]
                if x[0] == "method":
                    self.fail("bad pattern")
                if x[0] != "hole":
                    self.target(x, True)
            return
        self.fail("invalid assignment target before")

    def parameter(self, e: tuple, names: list[str]) -> None:
        kind = e[0]
        if kind == "assign":
            return self.parameter(e[1], names)
        if kind == "id":
            if not self.name_ok(e[1]) or self.strict and e[1] in ("eval", "arguments"):
                self.fail("restricted name")
            names.append(e[1])
        elif kind == "spread":
            if e[1][0] == "assign":
                self.fail("bad rest")
            self.parameter(e[1], names)
        elif kind in ("object", "array"):
            for x in e[1]:
                if x[0] == "method":
                    self.fail("bad pattern")
                if x[0] != "hole":
                    self.parameter(x, names)
        else:
            self.fail("bad parameter before")

    def conditional(self, allow_in: bool) -> tuple:
        e = self.binary(0, allow_in)
        if self.at("?"):
            self.plain(e)
            self.advance()
            self.assignment()
            self.expect(":")
            self.assignment(allow_in)
            return OTHER
        return e

    def plain(self, e: tuple) -> None:
        if e[0] == "params" and e[2] is False and e[3]:
            self.fail("parameters without an arrow")

    def binary(self, least: int, allow_in: bool) -> tuple:
        if self.kind == "h" and self.peek()[1] == "in":
            self.advance()
            left = OTHER
        else:
            left = self.unary()
        mixed = 0
        while True:
            op = self.value
            rank = BINARY.get(op, 0) if self.kind == "p" or op in ("in", "instanceof") and self.kind == "n" else 0
            if not rank or rank <= least or op == "in" and not allow_in:
                return left
            self.plain(left)
            if left[0] == "arrow":
                self.fail()
            if op == "**" and left[0] == "unary":
                self.fail("unary before **")
            kind = 1 if op == "??" else 2 if op in ("||", "&&") else 0
            if kind and mixed and kind != mixed or kind and left[0] == "logic" and left[1] != kind:
                self.fail("?? mixed with || or &&")
            mixed = kind or mixed
            self.advance()
            right = self.binary(rank - 1 if op == "**" else rank, allow_in)
            if kind and right[0] == "logic" and right[1] != kind:
                self.fail("?? mixed with || or &&")
            self.plain(right)
            left = ("logic", kind) if kind else OTHER

    def unary(self) -> tuple:
        v, k = self.value, self.kind
        if k == "p":
            if v in ("!", "~", "+", "-"):
                self.advance()
                self.plain(self.unary())
                return ("unary",)
            if v in ("++", "--"):
                self.advance()
                self.target(self.unary(), False)
                return OTHER
        elif k == "n":
            if v in ("typeof", "void", "delete"):
                self.advance()
                e = self.unary()
                if v == "delete" and self.strict and e[0] == "id":
                    self.fail("delete of a name")
                return ("unary",)
            if v == "await" and self.is_async:
                self.advance()
                self.unary()
                return ("unary",)
        e = self.unary_tail()
        if self.kind == "p" and self.value in ("++", "--") and not self.newline:
            self.target(e, False)
            self.advance()
            return OTHER
        return e

    def arguments(self) -> tuple[list[tuple], bool]:
        """Arguments after '('; whether the last is followed by a comma."""
        out, trailing = [], False
        while not self.eat(")"):
            spread = self.eat("...")
            e = self.assignment(True, True)
            out.append(("spread", e) if spread else e)
            trailing = False
            if not self.at(")"):
                self.expect(",")
                trailing = True
        return out, trailing

    def unary_tail(self) -> tuple:
        mark = len(self.cover)
        maybe_async = self.kind == "n" and self.value == "async"
        e = self.primary()
        chain = False
        while True:
            if e[0] == "arrow" or e[0] == "params" and self.at("=>"):
                return e
            if self.kind != "p":
                return e
            v = self.value
            if v == ".":
                self.plain(e)
                self.advance()
                if self.kind not in ("n", "h", "escaped"):
                    self.fail()
                self.advance()
                e = ("chain",) if chain else ("member",)
            elif v == "(":
                newline = self.newline
                self.plain(e)
                self.advance()
                inner = len(self.cover)
                args, trailing = self.arguments()
                if maybe_async and e == ("id", "async") and self.at("=>") and not newline:
                    return ("params", args, True, True)
                self.covered(inner)
                e = ("chain",) if chain else ("call",)
            elif v == "[":
                self.plain(e)
                self.advance()
                self.expression()
                self.expect("]")
                e = ("chain",) if chain else ("member",)
            elif v == "?.":
                self.plain(e)
                chain = True
                self.advance()
                if self.eat("("):
                    inner = len(self.cover)
                    self.arguments()
                    self.covered(inner)
                elif self.eat("["):
                    self.expression()
                    self.expect("]")
                elif self.kind in ("n", "h", "escaped"):
                    self.advance()
                else:
                    self.fail()
                e = ("chain",)
            elif v == "`":
                if chain:
                    self.fail()
                self.template(True)
                e = OTHER
            else:
                return e
            maybe_async = False
            if e[0] != "params":
                mark = mark  # parenthesised patterns stay in cover until their arrow

    def template(self, tagged: bool = False) -> None:
        while True:
            m = TEMPLATE.match(self.text, self.pos)
            if not m:
                self.fail("unclosed template")
            if not tagged and "\\" in m.group() and (BAD_ESCAPE.search(m.group()) or OCTAL_ESCAPE.search(m.group())):
                self.fail("bad escape")
            self.pos = m.end()
            if m.group(1) == "`":
                return self.advance()
            self.advance()
            self.expression()
            if not self.at("}"):
                self.fail("unclosed template part")

    def primary(self) -> tuple:
        v, k = self.value, self.kind
        if k == "n":
            if v == "function" or v == "async" and self.peek() == ("n", "function", False):
                self.function(False)
                return OTHER
            if v == "class":
                self.class_(False)
                return OTHER
            if v in ("this", "null", "true", "false"):
                self.advance()
                return OTHER
            if v == "new":
                return self.new()
            if v == "super":
                if not self.may_super:
                    self.fail()
                self.advance()
                if not (self.at("(") or self.at(".") or self.at("[")):
                    self.fail()
                return OTHER
            if v == "import":
                self.advance()
                if not self.at("("):
                    self.fail("module syntax in a script")
                return OTHER
            if not self.name_ok(v):
                self.fail("reserved word")
            self.advance()
            return ("id", v)
        if k == "d" or k == "s":
            self.advance()
            return OTHER
        if k == "p":
            if v == "(":
                return self.parenthesised()
            if v == "[":
                return self.array()
            if v == "{":
                return self.object()
            if v == "`":
                self.template()
                return OTHER
            if v == "/" or v == "/=":
                m = REGEX.match(self.text, self.start)
                if not m:
                    self.fail("bad regular expression")
                flags = FLAGS.match(self.text, m.end())
                if set(flags.group()) - set("dgimsuvy") or len(set(flags.group())) != len(flags.group()):
                    self.fail("bad flags")
                self.regex_groups(m.group()[1:-1])
                self.pos = flags.end()
                self.advance()
                return OTHER
        self.fail()
        return OTHER

    def regex_groups(self, body: str) -> None:
        body = re.sub(r"\\.|\[(?:[^\]\\]|\\.)*\]", "x", body)
        depth = 0
        for c in body:
            depth += (c == "(") - (c == ")")
            if depth < 0:
                break
        if depth or re.match(r"[*+?]", body) or re.search(r"[(|][*+]|\(\?(?![:=!<])", body) or re.search(r"[*+?]{3}|\*\*|\+\+|\*\+|\+\*|\?\?[*+?]", body):
            self.fail("bad regular expression")

    def new(self) -> tuple:
        self.advance()
        if self.eat("."):
            if not self.at("target") or not (self.in_function or self.in_class_field):
                self.fail()
            self.advance()
            return OTHER
        if self.at("import"):
            self.fail()
        if self.at("new"):
            self.new()
        else:
            self.plain(self.primary())
        while self.kind == "p":
            if self.eat("."):
                if self.kind not in ("n", "h", "escaped"):
                    self.fail()
                self.advance()
            elif self.eat("["):
                self.expression()
                self.expect("]")
            elif self.at("`"):
                self.template(True)
            elif self.at("?."):
                self.fail()
            else:
                break
        if self.eat("("):
            inner = len(self.cover)
            self.arguments()
            self.covered(inner)
        return OTHER

    def parenthesised(self) -> tuple:
        self.advance()
        mark = len(self.cover)
        items: list[tuple] = []
        only_arrow = self.at(")")
        while not self.at(")"):
            if self.eat("..."):
                names: list[str] = []
                self.binding(names)
                items.extend(("id", n) for n in names)
                only_arrow = True
                if not self.at(")"):
                    self.fail()
                break
            items.append(self.assignment(True, True))
            if not self.at(")"):
                self.expect(",")
                only_arrow = self.at(")")
        self.expect(")")
        if self.at("=>") and not self.newline:
            return ("params", items, False, True)
        if only_arrow:
            self.fail("parameters without an arrow")
        self.covered(mark)
        return ("paren", items[0] if len(items) == 1 else OTHER)

    def array(self) -> tuple:
        self.advance()
        items: list[tuple] = []
        rest_comma = False
        while not self.eat("]"):
            if self.eat(","):
                items.append(("hole",))
                continue
            spread = self.eat("...")
            e = self.assignment(True, True)
            items.append(("spread", e) if spread else e)
            if not self.at("]"):
                self.expect(",")
                rest_comma = spread
        return ("array", items, rest_comma)

    def object(self) -> tuple:
        self.advance()
        items: list[tuple] = []
        while not self.eat("}"):
            if self.eat("..."):
                items.append(("spread", self.assignment(True, True)))
            else:
                items.append(self.property())
            if not self.at("}"):
                self.expect(",")
        return ("object", items)

    def property(self) -> tuple:
        is_async = generator = False
        ends = ("(", ":", ",", "}", "=")
        if self.at("async"):
            kind, value, newline = self.peek()
            if not (kind == "p" and value in ends) and not newline:
                is_async = True
                self.advance()
        if self.eat("*"):
            generator = True
        if (self.at("get") or self.at("set")) and not is_async and not generator:
            kind, value, _ = self.peek()
            if not (kind == "p" and value in ends):
                self.advance()
                self.property_name()
                self.function_rest(False, False, True)
                return ("method",)
        kind, name = self.kind, self.value
        if kind == "h":
            self.fail()
        self.property_name()
        if self.at("("):
            self.function_rest(is_async, generator, True)
            return ("method",)
        if is_async or generator:
            self.fail()
        if self.eat(":"):
            return self.assignment(True, True)
        if kind != "n" or not self.name_ok(name):
            self.fail()
        if self.at("="):
            self.cover.append(self.start)
            self.advance()
            self.assignment()
            return ("assign", ("id", name))
        return ("id", name)


STATEMENTS = {
    "var": Parser.s_var, "const": Parser.s_const, "function": Parser.function_declaration, "class": Parser.s_class, "if": Parser.s_if,
    "for": Parser.s_for, "while": Parser.s_while, "do": Parser.s_do, "break": Parser.s_jump, "continue": Parser.s_jump,
    "return": Parser.s_return, "with": Parser.s_with, "switch": Parser.s_switch, "throw": Parser.s_throw, "try": Parser.s_try,
    "debugger": Parser.s_debugger, "import": Parser.s_import,
}


def check(text: str) -> None:
    """Raise ``JsSyntaxError`` unless ``text`` is a script."""
    Parser(text).program()
