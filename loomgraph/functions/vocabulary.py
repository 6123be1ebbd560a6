"""Names of calls that leave a project: the standard libraries' own names, by language, from their public documentation.

Python's names come from the interpreter's own tables. The other languages have short lists of what their documentation names first;
a deployment passes a table of its own.
"""

from __future__ import annotations

import builtins
import sys

# Names of standard libraries.
RUST = "Vec HashMap HashSet BTreeMap BTreeSet VecDeque String Option Some None Ok Err Result Box Rc Arc Mutex RwLock RefCell Cell Cow PathBuf Path Duration Instant new push pop len clone unwrap unwrap_or unwrap_or_else unwrap_or_default expect collect iter iter_mut into_iter map map_err and_then or_else ok_or filter filter_map flat_map fold for_each take skip zip enumerate rev chain cloned copied as_str as_ref as_mut as_bytes to_string to_owned to_vec into from try_into try_from is_empty is_some is_none is_ok is_err contains contains_key get get_mut insert remove extend drain retain split_whitespace trim starts_with ends_with lock read write send recv spawn println eprintln print format vec panic assert assert_eq assert_ne debug_assert todo unimplemented unreachable matches write writeln".split()
JAVASCRIPT = "require parseInt parseFloat isNaN isFinite encodeURIComponent decodeURIComponent setTimeout setInterval clearTimeout clearInterval queueMicrotask structuredClone fetch alert Array Object String Number Boolean Symbol BigInt Map Set WeakMap WeakSet Promise Proxy Reflect RegExp Date Error TypeError URL URLSearchParams push pop shift unshift slice splice concat join reverse indexOf lastIndexOf includes find findIndex findLast some every map filter reduce reduceRight forEach flat flatMap fill keys values entries assign freeze fromEntries hasOwnProperty charAt charCodeAt codePointAt padStart padEnd substring toLowerCase toUpperCase toString toFixed trim trimStart trimEnd match matchAll replace replaceAll then catch finally resolve reject all allSettled race addEventListener removeEventListener dispatchEvent querySelector querySelectorAll getElementById createElement appendChild preventDefault stopPropagation stringify parse".split()
JAVA = "println printf print format valueOf toString equals hashCode compareTo getClass clone wait notify notifyAll length charAt substring indexOf isEmpty isBlank split trim strip toLowerCase toUpperCase replace replaceAll add addAll remove removeIf get set put putIfAbsent computeIfAbsent getOrDefault containsKey containsValue contains size keySet values entrySet iterator hasNext next stream parallelStream map filter flatMap collect forEach reduce sorted distinct limit toList orElse orElseGet orElseThrow isPresent ifPresent of ofNullable asList singletonList emptyList unmodifiableList parseInt parseLong getMessage printStackTrace getName currentTimeMillis nanoTime sleep start join close read write flush append StringBuilder ArrayList HashMap HashSet LinkedList Optional Thread".split()
GO = "make append len cap copy delete panic recover print println new close complex real imag min max clear string int int64 float64 byte rune error Println Printf Sprintf Sprint Errorf Fprintf Fprintln Fatal Fatalf Error Is As Unwrap Join Split Contains HasPrefix HasSuffix TrimSpace Replace ReplaceAll ToLower ToUpper Atoi Itoa ParseInt Marshal Unmarshal NewReader NewWriter ReadAll ReadFile WriteFile Open Create Close Lock Unlock RLock RUnlock Add Done Wait Background WithCancel WithTimeout Now Since Sleep".split()
C = "printf fprintf sprintf snprintf vsnprintf scanf sscanf puts putchar getchar fgets fputs fopen fclose fread fwrite fseek ftell fflush malloc calloc realloc free memcpy memmove memset memcmp strlen strcpy strncpy strcat strncat strcmp strncmp strcasecmp strchr strrchr strstr strtok strdup strtol strtoul strtod atoi atol atof abs labs rand srand exit abort atexit qsort bsearch assert sizeof isalpha isdigit isspace tolower toupper time clock getenv perror open close read write make_unique make_shared make_pair move forward static_cast dynamic_cast reinterpret_cast const_cast push_back emplace_back begin end size empty clear insert erase find".split()
RUBY = "puts print p require require_relative raise attr_accessor attr_reader attr_writer include extend new each each_with_index each_with_object map select reject reduce inject find detect any all none sort sort_by group_by push pop shift unshift first last empty nil to_s to_i to_sym to_a to_h is_a respond_to send freeze dup merge fetch dig keys values join split gsub sub strip lambda proc".split()
PHP = "echo print isset unset empty count strlen strpos substr str_replace explode implode trim sprintf printf in_array array_map array_filter array_merge array_keys array_values array_push array_pop json_encode json_decode is_null is_array is_string var_dump die exit define call_user_func preg_match preg_replace file_get_contents".split()
CSHARP = "WriteLine ReadLine ToString Equals GetHashCode GetType Parse TryParse Add AddRange Remove Contains ContainsKey TryGetValue ToList ToArray ToDictionary Select Where First FirstOrDefault Single SingleOrDefault Any All OrderBy GroupBy Aggregate Sum Count Join Split Trim Substring Replace StartsWith EndsWith IsNullOrEmpty IsNullOrWhiteSpace ConfigureAwait Dispose nameof typeof".split()
DART = "print setState runApp toString forEach where toList toSet addAll removeWhere containsKey putIfAbsent firstWhere then whenComplete catchError listen cancel delayed".split()
# Beginnings of qualified names in standard libraries other than Python's.
OTHER_PREFIXES = ["std::", "core::", "alloc::", "Math.", "JSON.", "Object.", "Array.", "Number.", "Promise.", "Reflect.", "console.", "process.", "window.", "document.", "localStorage.", "fmt.", "strings.", "strconv.", "errors.", "bytes.", "bufio.", "filepath.", "sync.", "atomic.", "context.", "ioutil.", "System.", "String.", "Integer.", "Collections.", "Arrays.", "Objects.", "Collectors.", "Console.", "Convert.", "Enumerable.", "Task."]

#: Python's own: built-in names, and the methods of its basic types.
PYTHON = sorted({n for n in dir(builtins) if not n.startswith("_")} | {n for t in (str, bytes, list, dict, set, tuple, int, float) for n in dir(t) if not n.startswith("_")})
STDLIB = sorted({*PYTHON, *RUST, *JAVASCRIPT, *JAVA, *GO, *C, *RUBY, *PHP, *CSHARP, *DART})
PREFIXES = sorted({*OTHER_PREFIXES, *(f"{m}." for m in sys.stdlib_module_names if not m.startswith("_"))})

# Words before a parenthesis that are no calls, by language.
KEYWORDS_OF = {
    "python": "if for while return and or not in is with assert yield lambda def class elif except print del",
    "rust": "if for while loop match return let fn impl as in move where unsafe dyn ref mut pub crate self super Self",
    "typescript": "if for while switch catch return function typeof instanceof new delete void await async yield super import export throw do else case in of constructor get set static",
    "java": "if for while switch catch return new synchronized try throw super this assert do else case instanceof",
    "go": "if for switch select return func go defer range const var type import package case interface struct map chan",
    "ruby": "if unless while until case when return def class module yield and or not in begin rescue ensure super defined",
    "php": "if elseif for foreach while switch catch return function fn new array list echo print isset unset empty match use throw include require static self parent declare",
    "csharp": "if for foreach while switch catch return new using lock fixed typeof sizeof nameof default checked unchecked when throw base this await",
    "c": "if for while switch return sizeof catch new delete throw defined alignof decltype static_assert do else case typeof operator template",
    "dart": "if for while switch catch return new const super this assert throw await yield do else case in is as",
    "proto": "returns rpc stream option",
}
KEYWORDS_OF = {k: frozenset(v.split()) for k, v in KEYWORDS_OF.items()}
