"""Fixed values of the choice task: option names, task codes, level order and cue meanings."""

# Name of the option a participant selects -> column holding its task code.
OPTION_COLUMNS = {
    "relation1select": "relation1",
    "relation2select": "relation2",
    "r1d1select": "r1d1",
    "r1d2select": "r1d2",
    "r2d1select": "r2d1",
    "r2d2select": "r2d2",
}

# Name of the option -> column holding the cue shown with it.
CUE_COLUMNS = {
    "relation1select": "rel1cue",
    "relation2select": "rel2cue",
    "r1d1select": "r1d1cue",
    "r1d2select": "r1d2cue",
    "r2d1select": "r2d1cue",
    "r2d2select": "r2d2cue",
}

# Task codes "bubble factor,?,point change" of the first experiment.
TASK_CODES_SMALL_POINTS = {
    "0.5,0,0": "lessBubbles",
    "1,0,10": "morePoints",
    "1.5,0,0": "moreBubbles",
    "1,0,-10": "lessPoints",
    "0.25,0,0": "lessBubblesTwice",
    "0.5,0,-10": "lessBubbleslessPoints",
    "0.5,0,10": "lessBubblesmorePoints",
    "1,0,20": "morePointsTwice",
    "1.5,0,10": "morePointsmoreBubbles",
    "2.25,0,0": "moreBubblesTwice",
    "1.5,0,-10": "moreBubbleslessPoints",
    "1,0,-20": "lessPointsTwice",
}

# Task codes of the later experiments.
TASK_CODES_LARGE_POINTS = {
    "0.5,0,0": "lessBubbles",
    "1,0,50": "morePoints",
    "1.5,0,0": "moreBubbles",
    "1,0,-40": "lessPoints",
    "0.25,0,0": "lessBubblesTwice",
    "0.5,0,-40": "lessBubbleslessPoints",
    "0.5,0,50": "lessBubblesmorePoints",
    "1,0,100": "morePointsTwice",
    "1.5,0,50": "morePointsmoreBubbles",
    "2.25,0,0": "moreBubblesTwice",
    "1.5,0,-40": "moreBubbleslessPoints",
    "1,0,-45": "lessPointsTwice",
    "1,0,-50": "lessPointsTwice",
    "1,0,-55": "lessPointsTwice",
}

# Tasks that can be the optimal choice of a trial.
OPTIMAL_TASKS = [
    "lessBubbles",
    "morePoints",
    "lessBubblesTwice",
    "lessBubblesmorePoints",
    "morePointsTwice",
]

# Level order of the chosen task.
TASK_LEVELS = [
    "lessPoints",
    "moreBubbles",
    "morePoints",
    "lessBubbles",
    "lessPointsTwice",
    "moreBubblesTwice",
    "moreBubbleslessPoints",
    "morePointsmoreBubbles",
    "lessBubbleslessPoints",
    "lessBubblesmorePoints",
    "lessBubblesTwice",
    "morePointsTwice",
]

# The four one-step tasks, which are all that training offers.
ENTAILED_TASKS = ["lessPoints", "moreBubbles", "morePoints", "lessBubbles"]

# Tasks counted by each derived share of the test choices.
SHARE_TASKS = {
    "entailedChoices": ["lessPoints", "moreBubbles", "morePoints", "lessBubbles"],
    "entailedOptimal": ["morePoints", "lessBubbles"],
    "derivedChoices": [
        "lessPointsTwice", "moreBubblesTwice", "moreBubbleslessPoints", "morePointsmoreBubbles",
        "lessBubbleslessPoints", "lessBubblesmorePoints", "lessBubblesTwice", "morePointsTwice",
    ],
    "derivedOptimal": [
        "morePointsmoreBubbles", "lessBubbleslessPoints", "lessBubblesmorePoints",
        "lessBubblesTwice", "morePointsTwice",
    ],
    "lessBubblesChoices": ["lessBubbles", "lessBubbleslessPoints", "lessBubblesTwice"],
    "morePointsChoices": ["morePoints", "morePointsmoreBubbles", "morePointsTwice"],
    "choicesOptimalCues": [
        "lessBubblesmorePoints", "lessBubbles", "lessBubbleslessPoints", "lessBubblesTwice",
        "morePoints", "morePointsmoreBubbles", "morePointsTwice",
    ],
    "entDevOptimal": [
        "lessBubblesmorePoints", "lessBubbles", "lessBubblesTwice", "morePoints", "morePointsTwice",
    ],
    "lessBubblesmorePoints": ["lessBubblesmorePoints"],
}

# Fixed values: (counterbalancing condition, symbol, meaning).
CUE_MEANINGS = [
    ("1", "◗", "more points"),
    ("1", "■", "more bubbles"),
    ("1", "✦", "less bubbles"),
    ("1", "▾", "less points"),
    ("2", "◗", "less bubbles"),
    ("2", "■", "less points"),
    ("2", "✦", "more points"),
    ("2", "▾", "more bubbles"),
]
