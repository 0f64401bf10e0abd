"""Source texts for test submissions, with the count of every defect they have.

The counts are stated by hand for the text after a first comment line. Defects that aren't
named have no finding; None marks a text that doesn't parse.
"""

TEMPLATES: tuple[tuple[str, dict[str, int] | None], ...] = (
    ("def is_adult(age):\n    if age >= limit:\n        return True\n    else:\n        return False\n", {"redundant_if_else": 1}),
    ("def is_minor(age):\n    if age >= limit:\n        return False\n    else:\n        return True\n", {}),
    ("ready = total > floor\nif ready == True:\n    print(total)\n", {"redundant_comparison": 1}),
    ("ready = total\nif ready == True:\n    print(total)\n", {}),
    ("if not total == floor:\n    print(total)\n", {"redundant_not": 1}),
    ("if not total in floors:\n    print(total)\n", {}),
    ("if total > floor:\n    size = 1\nelif total < roof:\n    size = 1\nelse:\n    size = 0\n", {"duplicate_if": 1}),
    ("if total > floor:\n    size = 1\nelif total < roof:\n    size = 0\nelif total < wall:\n    size = 0\n", {"duplicate_if": 2}),
    ("if total > floor:\n    size = 1\nelse:\n    if total < roof:\n        size = 0\n", {"else_if": 1}),
    ("if total > floor:\n    if total < roof:\n        size = 0\n", {"nested_if": 1}),
    ("if check(total):\n    if total < roof:\n        size = 0\n", {}),
    ("if total > floor:\n    size = 1\nelif total <= floor:\n    size = 0\n", {"redundant_elif": 1}),
    ("if total > floor:\n    pass\nelse:\n    size = 0\n", {"empty_if": 1}),
    ("for i in range(len(values)):\n    print(values[i])\n", {"redundant_indexing": 1}),
    ("for i in range(len(values)):\n    values[i] = values[i]\n", {}),
    ("for i in values:\n    print(i)\n", {"misleading_iterator_name": 1, "one_letter_name": 1}),
    ("for value in values:\n    first = value + base + rate\n    second = value + base + rate\n", {"duplicate_expression": 1}),
    ("while count < limit:\n    print(count)\n    count += 1\n", {"while_as_for": 1}),
    ("while count < limit:\n    if count == stop:\n        break\n    count += 1\n", {}),
    ("total = total + price\n", {"augmentable_assignment": 1}),
    ("total = price + total\n", {}),
    ("if temperature < 10:\n    print(temperature)\n", {"magic_number": 1}),
    ("price = cost * 3\nlast = values[-1]\n", {"magic_number": 1}),
    ("def area(q):\n    return side\n", {"one_letter_name": 1}),
    ("list = values\nsum = total\n", {"built_in_name": 2}),
    ("total=price\n", {"inappropriate_formatting": 2}),
    ("def area( side ):\n   return side \n", {"inappropriate_formatting": 4}),
    ("def broken(:\n", None),
    ("if total = floor:\n    pass\n", None),
    ("print(total)\n", {}),
)

CALLS = ("print(open(name))\n", "import os\n", "from math import pi\n", "os.remove(name)\n", "print(total)\n", "def broken(:\n")
#: What ``unsafe_screen`` says of each.
REASONS = ("unsafe call is not allowed: open", "imports are not allowed: os", "imports are not allowed: math", "unsafe module access is not allowed: os", None, None)
