"""Captured behaviour of the sample functions: (function, arguments, output or error, assertion it leads to)."""

NAN = float("nan")
LETTERS = list("abcdefghijklmnopqrstuvwxyz")
WORDS20 = [f"word{i}" for i in range(20)]
EMOJI = "😀😃😄😁😆😅😂🤣😊😇"
EMPTY_RANGE = "ValueError: empty range for randrange() (0, 0, 0)"
DIVISION = "ZeroDivisionError: division by zero"

WORD_GAME = [
    ("load_words", [], "[list of 55900 items]", "not_null"),
    ("choose_word", [[]], "IndexError: list index out of range", "raises"),
    ("choose_word", [["apple"]], "apple", "member"),
    ("choose_word", [["cat", "dog", "mouse"]], "dog", "member"),
    ("choose_word", [["", " ", "\t"]], " ", "member"),
    ("choose_word", [["123", "abc123", "!!!"]], "123", "member"),
    ("choose_word", [["repeat", "repeat", "repeat"]], "repeat", "member"),
    ("choose_word", [WORDS20], "word7", "member"),
    ("choose_word", [[42, "hello", None]], None, "member"),
    ("choose_word", [["a" * 200]], "a" * 200, "member"),
    ("has_player_won", ["apple", list("aple")], True, "is_bool"),
    ("has_player_won", ["banana", list("ban")], True, "is_bool"),
    ("has_player_won", ["test", []], False, "is_bool"),
    ("has_player_won", ["", []], True, "is_bool"),
    ("has_player_won", ["abc", list("abcd")], True, "is_bool"),
    ("has_player_won", ["xyz", list("xy")], False, "is_bool"),
    ("has_player_won", ["mississippi", list("misp")], True, "is_bool"),
    ("has_player_won", ["hello", list("hello")], True, "is_bool"),
    ("has_player_won", ["dog", ["D", "o", "g"]], False, "is_bool"),
    ("get_word_progress", ["apple", list("ap")], "app__", "equal"),
    ("get_word_progress", ["banana", []], "______", "equal"),
    ("get_word_progress", ["hello", list("helo")], "hello", "equal"),
    ("get_word_progress", ["", ["a"]], "", "equal"),
    ("get_word_progress", ["mississippi", list("is")], "_ississi__i", "equal"),
    ("get_word_progress", ["test", list("ttex")], "te_t", "equal"),
    ("get_word_progress", ["xyz", list("XYZ")], "___", "equal"),
    ("get_word_progress", ["a", []], "_", "equal"),
    ("get_word_progress", ["a", ["a"]], "a", "member"),
    ("get_word_progress", ["abacaba", list("bc")], "_b_c_b_", "equal"),
    ("get_available_letters", [[]], "".join(LETTERS), "equal"),
    ("get_available_letters", [list("abc")], "defghijklmnopqrstuvwxyz", "equal"),
    ("get_available_letters", [LETTERS], "", "equal"),
    ("get_available_letters", [list("aabc")], "defghijklmnopqrstuvwxyz", "equal"),
    ("get_available_letters", [list("AbC")], "acdefghijklmnopqrstuvwxyz", "equal"),
    ("get_available_letters", [list("zxqa")], "bcdefghijklmnoprstuvwy", "equal"),
    ("get_available_letters", [list("1!a")], "bcdefghijklmnopqrstuvwxyz", "equal"),
    ("get_available_letters", [LETTERS + list("abc")], "", "equal"),
    ("get_available_letters", [["a", None]], "bcdefghijklmnopqrstuvwxyz", "equal"),
    ("revealed", ["apple", "aeiou"], "a", "member"),
    ("revealed", ["banana", "xyz"], EMPTY_RANGE, "raises"),
    ("revealed", ["mississippi", "sp"], "s", "member"),
    ("revealed", ["", "abc"], EMPTY_RANGE, "raises"),
    ("revealed", ["Aardvark", "aArdv"], "d", "member"),
    ("revealed", ["test123", "t1"], "1", "member"),
    ("revealed", ["hello", ""], EMPTY_RANGE, "raises"),
    ("unique_letters", [""], 0, "equal"),
    ("unique_letters", ["a"], 1, "equal"),
    ("unique_letters", ["aaaaa"], 1, "equal"),
    ("unique_letters", ["abcabc"], 3, "equal"),
    ("unique_letters", ["".join(LETTERS)], 26, "equal"),
    ("unique_letters", ["AaBbCc"], 6, "equal"),
    ("unique_letters", ["Hello, World!"], 10, "equal"),
    ("unique_letters", ["Mississippi"], 4, "equal"),
    ("unique_letters", ["1234567890"], 10, "equal"),
    ("unique_letters", [EMOJI], 10, "equal"),
]

BILLING = [
    ("process_transaction", ["100"], 105.0, "approx"),
    ("process_transaction", [0], DIVISION, "raises"),
    ("process_transaction", [-50], "ValueError: Transaction amount cannot be negative.", "raises"),
    ("process_transaction", ["0.0"], DIVISION, "raises"),
    ("process_transaction", ["1e3"], 1050.0, "approx"),
    ("process_transaction", ["   25.5  "], 26.775000000000002, "approx"),
    ("process_transaction", ["NaN"], NAN, "approx_nan"),
    ("process_transaction", [""], "ValueError: could not convert string to float: ''", "raises"),
    (
        "process_transaction",
        [None],
        "TypeError: float() argument must be a string or a real number, not 'NoneType'",
        "raises",
    ),
]
