"""Fixed values of the puzzle corpus: names, role words, sentence templates
and instruction texts.  They must equal the reference's so generated text
matches its format; they are listed here as text, in their original order."""

# Common first names used for puzzle characters.
COMMON_NAMES = ['Emma', 'Liam', 'Olivia', 'Noah', 'Ava', 'Ethan', 'Sophia',
                'Mason', 'Isabella', 'William', 'Mia', 'James', 'Charlotte',
                'Benjamin', 'Amelia', 'Lucas', 'Harper', 'Henry', 'Evelyn',
                'Alexander', 'Abigail', 'Michael', 'Emily', 'Daniel', 'Elizabeth',
                'Jacob', 'Sofia', 'Logan', 'Avery', 'Jackson', 'Ella', 'Sebastian',
                'Scarlett', 'Jack', 'Grace', 'Aiden', 'Chloe', 'Owen', 'Victoria',
                'Samuel', 'Riley', 'Matthew', 'Aria', 'Joseph', 'Lily', 'Luke',
                'Aurora', 'David', 'Zoey', 'Oliver', 'Penelope']

# Uncommon first names (name perturbation).
UNCOMMON_NAMES = [
    'Zephyr', 'Elowen', 'Caspian', 'Isolde', 'Osiris', 'Vesper', 'Thaddeus', 'Ondine',
    'Lysander', 'Xanthe', 'Oberon', 'Calliope', 'Leander', 'Eulalia', 'Florian', 'Forsythe',
    'Nephele', 'Peregrine', 'Ianthe', 'Lazarus', 'Elodie', 'Cillian', 'Ottoline', 'Evander',
    'Saffron', 'Caius', 'Zora', 'Cyprian', 'Amaryllis', 'Theron', 'Perdita', 'Ignatius',
    'Zephyrine', 'Balthazar', 'Melisande', 'Zinnia', 'Sylvester', 'Cosima', 'Leocadio',
    'Percival', 'Oceane', 'Evanthe', 'Zenobia', 'Eurydice', 'Quillan', 'Aeronwen',
    'Thorsten', 'Xiomara', 'Zephyrus', 'Ysolde'
]

# Alternative role-word pairs (plural = word + 's').
KNIGHT_KNAVE_PAIRS = [
    ['a pioneer', 'a laggard'],
    ['a saint', 'a sinner'],
    ['a hero', 'a villain'],
    ['an angel', 'a devil'],
    ['an altruist', 'an egoist'],
    ['a sage', 'a fool'],
]

# Puzzle opening, closing question and statement templates.
PREFIX = ('A very special island is inhabited only by {knight}s and {knave}s. ' +
          '{Knight}s always tell the truth, and {knave}s always lie. ')
POSTFIX = 'So who is {a_knight} and who is {a_knave}?'
TEMPLATES = [
    '{name} said that {content}.',
    '{name} told you that {content}.',
    '{name} said, "{content}."',
    '{name} stated, "{content}".',
    'According to {name}, "{content}".',
    '''In {name}'s words: "{content}".''',
    '{name} remarked, "{content}".',
    '"{content}," {name} declared.',
    '{name} was heard saying, "{content}".',
    '{name} expressed that {content}.',
    '"{content}" - {name}.',
    'As {name} put it, "{content}".',
    '{name} asserted: "{content}".',
    '"{content}," {name} mentioned.',
    '{name} commented, "{content}".',
    'In a statement by {name}: "{content}".',
    '{name} noted, "{content}".',
    '"{content}," {name} claimed.',
]

# Instruction texts of the evaluation and fine-tuning prompts.
SYSTEM_INSTRUCTION = '''Your task is to solve a logical reasoning problem. You are given set of statements from which you must logically deduce the identity of a set of characters.

You must infer the identity of each character. First, explain your reasoning. At the end of your answer, you must clearly state the identity of each character by following the format:

CONCLUSION:
(1) ...
(2) ...
(3) ...
'''

SYSTEM_INSTRUCTION_NO_REASON = '''Your task is to solve a logical reasoning problem. You are given set of statements from which you must logically deduce the identity of a set of characters.

You must infer the identity of each character. At the end of your answer, you must clearly state the identity of each character by following the format:

CONCLUSION:
(1) ...
(2) ...
(3) ...
'''

DEMONSTRATION_2CHAR_NO_REASON = '''### Question: A very special island is inhabited only by knights and knaves. Knights always tell the truth, and knaves always lie. You meet 2 inhabitants: Jack, and Sophia. Jack tells you that Sophia is not a knave. Sophia says that If Jack is a knight then Sophia is a knight. So who is a knight and who is a knave?
### Answer:
CONCLUSION:
(1) Jack is a knight
(2) Sophia is a knight
'''

DEMONSTRATION_2CHAR = '''### Question: A very special island is inhabited only by knights and knaves. Knights always tell the truth, and knaves always lie. You meet 2 inhabitants: Ella, and Penelope. In a statement by Ella: \"Ella is a knight or Penelope is a knight\". According to Penelope, \"Ella is a knave if and only if Penelope is a knight\". So who is a knight and who is a knave?
### Answer: Let's think step by step, by considering whether each person is lying and if that leads to contradiction. Assume Ella is a knight. Penelope cannot be a knight, because this would contradict the claim of their own. Penelope cannot be a knave, because this would contradict the false claim of their own. We have exhausted all possibilities for Penelope, so let us go back and reconsider Ella. Assume Ella is a knave. Penelope cannot be a knight, because this would contradict the false claim of Ella. Assume Penelope is a knave. This leads to a feasible solution.
CONCLUSION:
(1) Ella is a knave
(2) Penelope is a knave
'''

COT_HEAD = "Let's think step by step, by considering whether each person is lying and if that leads to contradiction."

# RL prompt texts for puzzles (chat system message, base template).
INSTRUCT_PROMPT = """You are a helpful assistant. The assistant first thinks about the reasoning process in the mind and then provides the user with the answer. The reasoning process and answer are enclosed within <think> </think> and<answer> </answer> tags, respectively, i.e., <think> reasoning process here </think><answer> answer here </answer>.  Now the user asks you to solve a logical reasoning problem. After thinking, when you finally reach a conclusion, clearly state the identity of each character within <answer> </answer> tags. i.e., <answer> (1) Zoey is a knight\n(2) ... </answer>."""
BASE_PROMPT = """The user asks a question, and the Assistant solves it. The assistant first thinks about the reasoning process in the mind and then provides the user with the final answer. The reasoning process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, i.e., <think> reasoning process here </think><answer> answer here </answer>. Now the user asks you to solve a logical reasoning problem. User:The final conclusion can only be determined after thinking and verifying its correctness. The identity of each character should be clearly written in the <answer> </answer> tags, and other thinking and verifying content should be in the <think> </think> tags. List the identity of each person one by one, for example, <answer> (1) Zoey is a knave\n(2) Oliver is a knight\n(3)... </answer>.\n{quiz}\nAssistant:<think>"""

# Instructions appended to math questions.
GSM8K_INSTRUCTION = "Let's think step by step and output the final answer after \"####\"."
MATH_INSTRUCTION = "Let's think step by step and output the final answer within \\boxed{}."

# Open-math base prompt, and the hard-coded chat templates of
# the evaluation modes ("zero" and "normal").
ORZ_BASE_PROMPT = """A conversation between User and Assistant. The user asks a question, and the Assistant solves it. The assistant first thinks about the reasoning process in the mind and then provides the user with the answer. The reasoning process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, i.e., <think> reasoning process here </think> <answer> answer here </answer>.\nUser: You must put your answer inside <answer> </answer> tags, i.e., <answer> answer here </answer>. And your final answer will be extracted automatically by the \\boxed{{}} tag. {prompt}\nAssistant: <think>"""
ZERO_TEMPLATE = """<|im_start|>system\nYou are a helpful assistant. The assistant first thinks about the reasoning process in the mind and then provides the user with the answer. The reasoning process and answer are enclosed within <think> </think> and<answer> </answer> tags, respectively, i.e., <think> reasoning process here </think><answer> answer here </answer>.  Now the user asks you to solve a logical reasoning problem. After thinking, when you finally reach a conclusion, clearly state the identity of each character within <answer> </answer> tags. i.e., <answer> (1) Zoey is a knight\n(2) ... </answer>.\n<|im_end|>\n<|im_start|>user\n{prompt}\n<|im_end|>\n<|im_start|>assistant\n<think>"""
NORMAL_TEMPLATE = """<|im_start|>user\n{prompt}\n<|im_end|>\n<|im_start|>assistant\n"""

# Reasoning-step sentences.
STEP_FOOTER_SUCCESS = 'This leads to a feasible solution.'
STEP_FOOTER_FAIL = 'All the configurations lead to contradictions.'
