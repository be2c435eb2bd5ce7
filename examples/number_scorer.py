"""A user's scorer, outside of the package: the number behind a mark against the truth."""


def score(data_source, solution, ground_truth, extra_info, mark="#### ", points=1.0):
    right = solution.rsplit(mark, 1)[1] == ground_truth
    return {"score": points if right else 0.0, "is_answer_right": right}
