"""The lexer against sources and configurations that are generated with what they hold."""

import random
import string
import time

from tessera.llm import op4_secret_scan as op4


def found(text):
    return [text[s:e] for s, e, k in op4.scan(text) if k == "literal"]


def key(r, n=None):
    return "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n or r.randrange(20, 40))) + "aB3"


def test_sums_of_sums_cost_what_is_written():
    for lines in (60, 3000):
        text = 'a0 = "aB3x9Zq7Lm2k"\n' + "".join(f"a{i} = a{i - 1} + a{i - 1}\n" for i in range(1, lines)) + f"private_key = a{lines - 1}\n"
        began = time.time()
        assert found(text) == ["aB3x9Zq7Lm2k"]
        assert time.time() - began < 1
    text = 'a0 = "aB3x9Zq7"\n' + "".join(f'a{i} = a{i - 1} + "k{i}Q"\nprivate_key{i} = a{i}\n' for i in range(1, 3000))
    began = time.time()
    assert len(found(text)) == 3000 and time.time() - began < 2


def test_generated_sources():
    r = random.Random(4)
    for _ in range(200):
        parts, expected = ["import os\n\ndef load(x):\n"], []
        for _ in range(r.randrange(1, 9)):
            k, name = key(r), r.choice(["private_key", "signingKey", "credentials", "access-key", "PASSPHRASE"])
            plain = name.replace("-", "_")
            line, wanted = r.choice(
                [
                    (f'    {plain} = "{k}"', [k]),
                    (f"    cfg['{name}'] = '{k}'", [k]),
                    (f'    cfg["{name}"] = rb"""{k}"""', [k]),
                    (f"    {plain} = '''{k}'''  # note", [k]),
                    (f'    set_{plain}("{k}")', [k]),
                    (f'    put( "{name}" , "{k}" )', [k]),
                    (f'    h = "{k}"\n    {plain} = h', [k]),
                    (f'    {plain} = "{k[:12]}" + "{k[12:]}"', [k[:12], k[12:]]),
                    (f'    # {plain} = "{k}"', [k]),
                    (f"    <{plain} type='x'> {k} </{plain}>", [k]),
                    (f"    <key>{name}</key>\n    <string>{k}</string>", [k]),
                    (f"    {plain} = {plain}", []),
                    (f'    {plain} = os.environ["{k}"]', []),
                    (f"    {plain} = load(value_of_{k})", []),
                    (f"    {plain} = other_name_{k}", []),
                    (f'    colour = "{k}"', []),
                    (f'    {plain} == "{k}"', []),
                    (f'    {plain} = "${{{k}}}"', []),
                ]
            )
            parts.append(line + "\n")
            expected += wanted
        text = "".join(parts)
        assert sorted(found(text)) == sorted(expected), text


def test_generated_configurations():
    r = random.Random(5)
    for _ in range(100):
        lines, expected = ["[main]" if r.random() < 0.5 else "# settings"], []
        for i in range(r.randrange(1, 7)):
            k = key(r)
            op = r.choice(["=", ": ", " = "])
            name = r.choice(["signing_key", "credentials", '"private.key"'])
            line, wanted = r.choice([(f"{name}{op}{k}", [k]), (f"{name}{op}'{k}'", [k]), (f"colour{i}{op}{k}", []), (f"export {name.strip(chr(34))}={k}", [k])])
            lines.append(line)
            expected += wanted
        text = "\n".join(lines)
        assert sorted(found(text)) == sorted(expected), text
        assert sorted(found(text + "\n\nand(some, prose)\n")) == sorted(expected)
    block = f"ssh:\n  private_key: |\n    {key(r, 30)}\n    {key(r, 30)}\n  colour: {key(r)}\n"
    assert found(block) == [line.strip() for line in block.split("\n")[2:4]]


def test_escapes_are_decoded_and_hostile_texts_take_linear_time():
    assert found('private_key = "aB3\\tx9Zq7Lm2kk"') == []  # a blank in the value
    assert found('private_key = "aB3\\"x9Zq7Lm2kk"') == ['aB3\\"x9Zq7Lm2kk']
    for part in ('f("', "'''", '"""', "<a>", "a: |\n", "[section]\n", "a[", "x=y\n", "put('a','b',", "<key>a</key>"):
        took = []
        for n in (20_000, 80_000):
            text = part * (n // len(part))
            began = time.time()
            op4.scan(text)
            took.append(time.time() - began)
        assert took[1] < 8 * max(took[0], 0.02), (part, took)
