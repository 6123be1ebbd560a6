"""A source of some dozen lines in each language, and the symbols and edges in it. @@ stands for a number that differs from file to file."""

# fmt: off
SOURCES = {
    "java": (
        "java",
        """\
package a.b;
import java.util.List;
@Service
public class J@@ extends Base implements Runnable {
    private static final int TOP = 1;
    private final Store store;

    public J@@(Store store) {
        this.store = prepare(store);
    }

    J@@(int a)
    {
        helper(a);
    }

    @Override
    public void run()
    {
        if (ready()) {
            store.save(load());
        }
    }

    protected abstract List<String> names(int a);

    void quiet(int a);

    interface Inner {
        int size();
    }
}
""",
        """
File  1 33
Class J@@ 4 32
Constant J@@::TOP 5 5
Constant J@@::store 6 6
Method J@@::<init> 8 10
Method J@@::<init> 12 15
Method J@@::run 18 23
Method J@@::names 25 25
Class J@@::Inner 29 31
""",
        """
. IMPORTS MODULE:java.util.List 2
. DEFINES J@@
J@@ INHERITS REF:Base 4
J@@ DEFINES J@@::TOP
J@@ DEFINES J@@::store
J@@ DEFINES J@@::<init>
J@@::<init> CALLS REF:prepare 9
J@@ DEFINES J@@::<init>
J@@::<init> CALLS REF:helper 14
J@@ DEFINES J@@::run
J@@::run CALLS REF:ready 20
J@@::run CALLS REF:store.save 21
J@@::run CALLS REF:load 21
J@@ DEFINES J@@::names
J@@ DEFINES J@@::Inner
""",
    ),
    "go": (
        "go",
        """\
package p

import (
	"fmt"
	x "net/http"
)

const (
	One@@ = 1
	Two
)

var Limit = 3

// T is a thing.
type T@@ struct {
	name string
}

type Alias = int

func (t *T@@) Go(x int) error {
	if check(x) {
		return t.fail(x)
	}
	for i := range items(x) {
		use(i)
	}
	return nil
}

func Free@@(x int) {
	Do(x)
}
""",
        """
File  1 35
Constant One@@ 9 9
Constant Two 10 10
Constant Limit 13 13
Class T@@ 16 18
Class Alias 20 20
Method T@@::Go 22 30
Function Free@@ 32 34
""",
        """
. IMPORTS MODULE:fmt 4
. IMPORTS MODULE:net/http 5
. DEFINES One@@
. DEFINES Two
. DEFINES Limit
. DEFINES T@@
. DEFINES Alias
T@@ DEFINES T@@::Go
T@@::Go CALLS REF:check 23
T@@::Go CALLS REF:t.fail 24
T@@::Go CALLS REF:items 26
T@@::Go CALLS REF:use 27
. DEFINES Free@@
Free@@ CALLS REF:Do 33
""",
    ),
    "c": (
        "c",
        """\
#include <stdio.h>
#include "own.h"
#define TOP@@ 3

struct point@@ {
  int x;
};

static int add@@(int a,
                 int b)
{
  if (a > b) {
    return sub(a, b);
  }
  return combine(a);
}

int decl(int a);

void plain@@(void) {
  add@@(1, 2);
  run(3);
}
""",
        """
File  1 24
Constant TOP@@ 3 3
Class point@@ 5 7
Function add@@ 9 16
Function plain@@ 20 23
""",
        """
. IMPORTS MODULE:stdio.h 1
. IMPORTS MODULE:own.h 2
. DEFINES TOP@@
. DEFINES point@@
. DEFINES add@@
add@@ CALLS REF:sub 13
add@@ CALLS REF:combine 15
. DEFINES plain@@
plain@@ CALLS REF:add@@ 21
plain@@ CALLS REF:run 22
""",
    ),
    "cpp": (
        "cpp",
        """\
namespace app {
class Shape@@ : public Base {
 public:
  Shape@@(int a) : a_(a) {
    init_shape(a);
  }
  int area() const override {
    return width() * 2;
  }
  void later(int a);
};

void Shape@@::later(int a)
{
  helper(a);
}
}
""",
        """
File  1 18
Class app 1 17
Class app::Shape@@ 2 11
Method app::Shape@@::Shape@@ 4 6
Method app::Shape@@::area 7 9
Method app::later 13 16
""",
        """
. DEFINES app
app DEFINES app::Shape@@
app::Shape@@ INHERITS REF:Base 2
app::Shape@@ DEFINES app::Shape@@::Shape@@
app::Shape@@::Shape@@ CALLS REF:init_shape 5
app::Shape@@ DEFINES app::Shape@@::area
app::Shape@@::area CALLS REF:width 8
app DEFINES app::later
app::later CALLS REF:helper 15
""",
    ),
    "ruby": (
        "rb",
        """\
require 'set'
module Outer@@
  class R@@ < Q
    LIMIT = 3
    attr_accessor :name, :size
    def go?(a)
      if check(a)
        call(a) # no(1)
      end
    end

    def self.build(x)
      wrap(x)
    end
  end
end
""",
        """
File  1 17
Class Outer@@ 2 16
Class Outer@@::R@@ 3 15
Constant Outer@@::R@@::LIMIT 4 4
Method Outer@@::R@@::name 5 5
Method Outer@@::R@@::size 5 5
Method Outer@@::R@@::go? 6 10
Method Outer@@::R@@::build 12 14
""",
        """
. IMPORTS MODULE:set 1
. DEFINES Outer@@
Outer@@ DEFINES Outer@@::R@@
Outer@@::R@@ INHERITS REF:Q 3
Outer@@::R@@ DEFINES Outer@@::R@@::LIMIT
Outer@@::R@@ DEFINES Outer@@::R@@::name
Outer@@::R@@ DEFINES Outer@@::R@@::size
Outer@@::R@@ DEFINES Outer@@::R@@::go?
Outer@@::R@@::go? CALLS REF:check 7
Outer@@::R@@::go? CALLS REF:call 8
Outer@@::R@@ DEFINES Outer@@::R@@::build
Outer@@::R@@::build CALLS REF:wrap 13
""",
    ),
    "php": (
        "php",
        """\
<?php
namespace App\\Models;
use A\\B;
use C\\D as E;
abstract class P@@ extends Q
{
    const TOP = 1;
    private ?string $name = null;
    public static int $count;
    public function __construct(string $name)
    {
        $this->name = clean($name);
    }
    protected function go($a): int
    {
        foreach ($a as $b) {
            $this->call($b);
        }
        return self::make($a);
    }
}
function top@@($x) {
    return work($x);
}
""",
        """
File  1 25
Class P@@ 5 21
Constant P@@::TOP 7 7
Constant P@@::name 8 8
Constant P@@::count 9 9
Method P@@::__construct 10 13
Method P@@::go 14 20
Function top@@ 22 24
""",
        """
. IMPORTS MODULE:A\\B 3
. IMPORTS MODULE:C\\D 4
. DEFINES P@@
P@@ INHERITS REF:Q 5
P@@ DEFINES P@@::TOP
P@@ DEFINES P@@::name
P@@ DEFINES P@@::count
P@@ DEFINES P@@::__construct
P@@::__construct CALLS REF:clean 12
P@@ DEFINES P@@::go
P@@::go CALLS REF:this.call 17
P@@::go CALLS REF:self::make 19
. DEFINES top@@
top@@ CALLS REF:work 23
""",
    ),
    "csharp": (
        "cs",
        """\
using System;
using Some.Space;
namespace N {
  public class C@@ : Base {
    private readonly int _x = 3;
    public string Name { get; set; }
    public C@@(int x)
    {
      _x = Check(x);
    }
    public async Task<int> Go(int a)
    {
      while (More(a)) {
        await Step(a);
      }
      return Call(a);
    }
    int Hidden(int a);
  }
}
""",
        """
File  1 21
Class C@@ 4 19
Constant C@@::_x 5 5
Constant C@@::Name 6 6
Method C@@::<init> 7 10
Method C@@::Go 11 17
""",
        """
. IMPORTS MODULE:System 1
. IMPORTS MODULE:Some.Space 2
. DEFINES C@@
C@@ INHERITS REF:Base 4
C@@ DEFINES C@@::_x
C@@ DEFINES C@@::Name
C@@ DEFINES C@@::<init>
C@@::<init> CALLS REF:Check 9
C@@ DEFINES C@@::Go
C@@::Go CALLS REF:More 13
C@@::Go CALLS REF:Step 14
C@@::Go CALLS REF:Call 16
""",
    ),
    "dart": (
        "dart",
        """\
library things;
import 'x.dart';
part 'y.dart';
const limit@@ = 3;
typedef Fn = void Function(int);
class D@@ extends E {
  final int a;
  D@@(this.a) {
    start(a);
  }
  D@@.named(int b) : a = b;
  void go(int a) {
    call(a);
  }
  int get size => count(a);
}
void main@@() {
  run(D@@(1));
}
""",
        """
File  1 20
Constant limit@@ 4 4
Class Fn 5 5
Class D@@ 6 16
Method D@@::D@@ 8 10
Method D@@::D@@.named 11 11
Method D@@::go 12 14
Method D@@::size 15 15
Function main@@ 17 19
""",
        """
. IMPORTS MODULE:x.dart 2
. IMPORTS MODULE:y.dart 3
. DEFINES limit@@
. DEFINES Fn
. DEFINES D@@
D@@ INHERITS REF:E 6
D@@ DEFINES D@@::D@@
D@@::D@@ CALLS REF:start 9
D@@ DEFINES D@@::D@@.named
D@@ DEFINES D@@::go
D@@::go CALLS REF:call 13
D@@ DEFINES D@@::size
D@@::size CALLS REF:count 15
. DEFINES main@@
main@@ CALLS REF:run 18
main@@ CALLS REF:D@@ 18
""",
    ),
    "vb": (
        "vb",
        """\
Module M
End Module
""",
        """
File  1 3
""",
        """

""",
    ),
    "typescript": (
        "ts",
        """\
import { a } from './mod';
import axios from 'axios';
// Wires things.
app.use('/api', routes);
app.use(cors());
axios.interceptors.request.use((c) => {
  return c;
});
socket.on('user:left', (x) => {
  gone(x);
});
export class K@@ extends Base {
  run(x: number): void {
    this.call(x); // no()
  }
}
export const arrow@@ = (x) => {
  k(x);
};
const TOP = 3;
""",
        """
File  1 21
Configuration middleware__api 4 4
Configuration middleware_cors 5 5
Configuration axios_request_interceptor 6 8
Configuration socket_on_user_left 9 11
Class K@@ 12 16
Method K@@::run 13 15
Function arrow@@ 17 19
Constant TOP 20 20
""",
        """
. IMPORTS MODULE:./mod 1
. IMPORTS MODULE:axios 2
. DEFINES middleware__api
. CALLS REF:app.use 4
. DEFINES middleware_cors
. CALLS REF:app.use 5
. CALLS REF:cors 5
. DEFINES axios_request_interceptor
. CALLS REF:axios.interceptors.request.use 6
. DEFINES socket_on_user_left
. CALLS REF:socket.on 9
. CALLS REF:gone 10
. DEFINES K@@
K@@ INHERITS REF:Base 12
K@@ DEFINES K@@::run
K@@::run CALLS REF:this.call 14
. DEFINES arrow@@
arrow@@ CALLS REF:k 18
. DEFINES TOP
""",
    ),
    "rust": (
        "rs",
        """\
use std::fs;
/// A thing.
pub struct S@@ {
    a: u32,
}
pub enum E@@ {
    One,
    Two(u32),
}
impl Show for S@@ {
    pub fn go(&self, x: u32) -> u32 {
        helper(x);
        Self::other();
        Thing::new(x)
    }
}
const MAX: u32 = 3;
fn free@@() {
    let p = Point { x: 1 };
    s.go();
}
""",
        """
File  1 22
Class S@@ 3 5
Class E@@ 6 9
Function E@@::One 7 7
Function E@@::Two 8 8
Method S@@::go 11 15
Constant MAX 17 17
Function free@@ 18 21
""",
        """
. IMPORTS MODULE:std::fs 1
. DEFINES S@@
. DEFINES E@@
E@@ DEFINES E@@::One
E@@ DEFINES E@@::Two
S@@ INHERITS REF:Show 10
S@@ DEFINES S@@::go
S@@::go CALLS REF:helper 12
S@@::go CALLS REF:Self::other 13
S@@::go CALLS REF:Thing::new 14
S@@::go INSTANTIATES REF:Thing 14
. DEFINES MAX
. DEFINES free@@
free@@ INSTANTIATES REF:Point 19
free@@ CALLS REF:s.go 20
""",
    ),
    "python": (
        "py",
        """\
import os
from m import q as r
LIMIT = 3


@wrap
class A@@(B):
    \"\"\"Doc.\"\"\"

    def go(self, x: int) -> str:
        return r(self.stop(x))

    async def wait(self):
        def inner():
            work()
        inner()


def top@@():
    os.path.join("a")


if True:
    def late():
        pass
""",
        """
File  1 26
Constant LIMIT 3 3
Class A@@ 7 16
Method A@@::go 10 11
Method A@@::wait 13 16
Function A@@::wait::inner 14 15
Function top@@ 19 20
Function late 24 25
""",
        """
. IMPORTS MODULE:os 1
. IMPORTS MODULE:m.q 2
. DEFINES LIMIT
. DEFINES A@@
A@@ CALLS REF:wrap 6
A@@ INHERITS REF:B 7
A@@ DEFINES A@@::go
A@@::go CALLS REF:m.q 11
A@@::go CALLS REF:self.stop 11
A@@ DEFINES A@@::wait
A@@::wait CALLS REF:work 15
A@@::wait CALLS REF:inner 16
A@@::wait DEFINES A@@::wait::inner
A@@::wait::inner CALLS REF:work 15
. DEFINES top@@
top@@ CALLS REF:os.path.join 20
. DEFINES late
""",
    ),
    "proto": (
        "proto",
        """\
syntax = "proto3";
import "other.proto";

// Asked.
message Ask@@ {
  string name = 1;
}

message Reply {
  enum Kind {
    NONE = 0;
  }
}

service S@@ {
  rpc Get (Ask@@) returns (Reply);
  rpc Watch (stream Ask@@) returns (stream Reply) {}
}
""",
        """
File  1 19
Class Ask@@ 5 7
Class Reply 9 13
Class Reply::Kind 10 12
Class S@@ 15 18
Function S@@::Get 16 16
Function S@@::Watch 17 17
""",
        """
. IMPORTS MODULE:other.proto 2
. DEFINES Ask@@
. DEFINES Reply
Reply DEFINES Reply::Kind
. DEFINES S@@
S@@ DEFINES S@@::Get
S@@::Get CALLS REF:Ask@@
S@@::Get CALLS REF:Reply
S@@ DEFINES S@@::Watch
S@@::Watch CALLS REF:Ask@@
S@@::Watch CALLS REF:Reply
""",
    ),
    "svelte": (
        "svelte",
        """\
<h1>x</h1>
<script context="module">
export const TOP = 1;
</script>
<p>y</p>
<script lang="ts">
function s@@() {
  t();
}
</script>
""",
        """
File  1 11
Constant TOP 3 3
Function s@@ 7 9
""",
        """
. DEFINES TOP
. DEFINES s@@
s@@ CALLS REF:t 8
""",
    ),
}
