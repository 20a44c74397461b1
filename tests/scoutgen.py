"""Invented match files and the rows they stand for."""

import random

TEAMS = {"*": ("1", "Team A"), "a": ("2", "Team B")}
SHIRTS = {"*": [1, 2, 4, 7, 9, 11, 15, 18], "a": [3, 5, 8, 10, 12, 14, 21, 33]}


def player_id(side, shirt):
    return str(-(1000 if side == "*" else 2000) - shirt)


def player_name(side, shirt):
    return f"First{shirt} Last{side_name(side)}{shirt}"


def side_name(side):
    return "H" if side == "*" else "V"


def other(side):
    return "a" if side == "*" else "*"


class Match:
    """A match in play: writes lines and keeps the expected serve-receive rows."""

    def __init__(self, seed, sets=3, rallies=14):
        self.rng = random.Random(seed)
        self.lines, self.expected, self.phases = [], [], []
        self.point = 0
        self.serving = "*"
        self.court = {side: list(SHIRTS[side][:6]) for side in "*a"}
        self.setter_slot = {"*": 1, "a": 4}
        self.won = {"*": 0, "a": 0}
        self.finals = []
        for number in range(1, sets + 1):
            self.play_set(number, rallies)

    # one line of the last section
    def line(self, code, set_number):
        fields = [code, "", "", "", "-1-1", "-1-1", "-1-1", "", str(set_number)]
        fields += [str(self.setter_slot["*"]), str(self.setter_slot["a"]), "2", "905", ""]
        fields += [str(n) for n in self.court["*"]] + [str(n) for n in self.court["a"]] + [""]
        self.lines.append(";".join(fields))

    def play_set(self, number, rallies):
        self.score = {"*": 0, "a": 0}
        for side in "*a":
            self.line(f"{side}P{self.court[side][0]:02d}>LUp", number)
            self.line(f"{side}z{self.setter_slot[side]}>LUp", number)
        for rally in range(rallies):
            self.play_rally(number, rally)
            if rally == 4:  # substitution: a short line
                out, new = self.court["*"][2], next(n for n in SHIRTS["*"] if n not in self.court["*"])
                self.lines.append(f"*c{out:02d}:{new:02d};;;;77;88;99;;{number};3;4;2;905;;")
                self.court["*"][2] = new
        self.finals.append(f"{self.score['*']}-{self.score['a']}")
        self.won[max("*a", key=lambda side: self.score[side])] += 1
        # the set field of this line already holds the next set
        self.line(f"**{number}set", number + 1)

    def touch(self, side, slot, skill, evaluation, combination="~~", target="~", set_number=1):
        shirt = self.court[side][slot]
        self.line(f"{side}{shirt:02d}{skill}M{evaluation}{combination}{target}15A~~33", set_number)
        return shirt

    def play_rally(self, number, rally):
        self.point += 1
        serve_side, receive_side = self.serving, other(self.serving)
        kind = ["full", "ace", "overpass", "fault", "no_set", "blank_code", "long"][rally % 7]
        start = dict(self.score)
        server = self.court[serve_side][0]
        row = {
            "point_id": self.point,
            "set_number": number,
            "serving_team": TEAMS[serve_side][1],
            "receiving_team": TEAMS[receive_side][1],
            "home_setter_position": self.setter_slot["*"],
            "visiting_setter_position": self.setter_slot["a"],
            "server_id": player_id(serve_side, server),
            "server_name": player_name(serve_side, server),
            "home_score_start_of_point": start["*"],
            "visiting_score_start_of_point": start["a"],
            "score_diff": start["*"] - start["a"],
            "setter_id": None,
            "setter_name": None,
            "set_code": None,
            "set_type": None,
            "attacker_id": None,
            "attacker_name": None,
            "attack_code": None,
            "attack_eval_code": None,
        }
        for side, name in (("*", "home"), ("a", "visiting")):
            for slot, shirt in enumerate(self.court[side], 1):
                row[f"{name}_p{slot}"] = shirt
                row[f"{name}_player_id{slot}"] = player_id(side, shirt)

        def t(side, slot, skill, evaluation, combination="~~", target="~"):
            return self.touch(side, slot, skill, evaluation, combination, target, number)

        winner = self.rng.choice("*a")
        received = True
        if kind == "fault":
            t(serve_side, 0, "S", "=")
            received, winner = False, receive_side
            row["serve_eval_code"] = "="
        elif kind == "ace":
            t(serve_side, 0, "S", "#")
            receiver, code = t(receive_side, 4, "R", "="), "="
            winner, row["serve_eval_code"] = serve_side, "#"
        elif kind == "overpass":
            t(serve_side, 0, "S", "/")
            receiver, code = t(receive_side, 5, "R", "/"), "/"
            t(serve_side, 3, "A", "#", "XP")
            # after the serving side touched the ball, the receivers are in transition
            t(receive_side, 1, "E", "#", "K9", "B")
            t(receive_side, 2, "A", "+", "X9")
            winner, row["serve_eval_code"] = serve_side, "/"
        else:
            code = self.rng.choice("#+!-")
            t(serve_side, 0, "S", "-")
            receiver = t(receive_side, 5, "R", code)
            row["serve_eval_code"] = "-"
            if kind != "no_set":
                setter = t(receive_side, 1, "E", "#", "K1", "F")
                row.update(
                    setter_id=player_id(receive_side, setter),
                    setter_name=player_name(receive_side, setter),
                    set_code="K1",
                    set_type="F",
                )
            combination = "~~" if kind == "blank_code" else self.rng.choice(["X5", "X6", "V5"])
            attacker = t(receive_side, self.rng.choice([2, 3, 4]), "A", "+", combination)
            row.update(
                attacker_id=player_id(receive_side, attacker),
                attacker_name=player_name(receive_side, attacker),
                attack_code=None if combination == "~~" else combination,
                attack_eval_code="+",
            )
            if kind == "long":
                t(serve_side, 2, "D", "+")
                t(serve_side, 3, "A", "+", "X8")
                t(receive_side, 1, "E", "#", "K7", "C")
                t(receive_side, 3, "A", "#", "X1")
        self.score[winner] += 1
        self.line(f"{winner}p{self.score['*']:02d}:{self.score['a']:02d}", number)
        if received:
            row.update(
                receiver_id=player_id(receive_side, receiver),
                receiver_name=player_name(receive_side, receiver),
                receive_eval_code=code,
                point_won_by=TEAMS[winner][1],
                is_ace=row["serve_eval_code"] == "#",
                is_overpass=code in "/=",
                out_of_system=code in "-!",
                no_set=row["setter_id"] is None,
                no_attack=row["attacker_id"] is None,
                home_team="Team A",
                visiting_team="Team B",
                home_team_id="1",
                visiting_team_id="2",
            )
            before = self.expected[-1]["point_won_by"] if self.expected else None
            row["prev_point_won"] = None if before is None else before == "Team A"
            self.expected.append(row)
        if winner == receive_side:  # side out: the new serving side rotates
            self.serving = receive_side
            self.court[receive_side] = self.court[receive_side][1:] + self.court[receive_side][:1]
            self.setter_slot[receive_side] = (self.setter_slot[receive_side] - 2) % 6 + 1

    def text(self):
        head = ["[3HEADER]", "FILEFORMAT: 2.0", "[3MATCH]", "17/05/2031;19.30.00;Friendly;;;", "[3TEAMS]"]
        for side in "*a":
            head.append(f"{TEAMS[side][0]};{TEAMS[side][1]};{self.won[side]};;;;")
        # a comment that looks like a touch must not count
        head += ["[3COMMENTS]", "a10SQ+~~~15A~~~33;;;;", "[3SET]"]
        head += [f"True;5-3;11-9;17-12;{final};19;" for final in self.finals]
        for side, section in (("*", "[3PLAYERS-H]"), ("a", "[3PLAYERS-V]")):
            head.append(section)
            for place, shirt in enumerate(SHIRTS[side], 1):
                libero = "L" if place == 8 else ""
                head.append(
                    f"{0 if side == '*' else 1};{shirt};{place};1;*;;;;{player_id(side, shirt)};"
                    f"Last{side_name(side)}{shirt};First{shirt};Nick;{libero};;;;;"
                )
        head += ["[3ATTACKCOMBINATION]", "X5;3;C;T;Wide step;;1234;1357;C;;", "X6;1;C;M;Far post;;4321;2468;S;;"]
        head += ["[3SETTERCALL]", "K1;;Fast middle;;65280;1212;;;;", "[3WINNINGSYMBOLS]", "#~~~=", "[3RESERVE]"]
        return "\r\n".join([*head, "[3SCOUT]", *self.lines]) + "\r\n"


def write_season(folder, games):
    """``games``: file name -> seed. Returns file name -> Match."""
    matches = {}
    for name, seed in games.items():
        matches[name] = Match(seed)
        (folder / name).write_text(matches[name].text(), newline="")
    return matches
